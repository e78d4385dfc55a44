"""Ordered series: (series, t, y) rows with t increasing within a series.

Windows are partitioned by the series.  A series is a curve of bounded length (days, turns,
revisions), not the raw events, so one partition of a window holds one curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _w():
    return Window.partitionBy("series").orderBy("t")


def derivative(df: DataFrame) -> DataFrame:
    """(series, t, y, d1, d2): first difference and centred second difference."""
    return df.select("series", "t", "y", (F.col("y") - F.lag("y").over(_w())).alias("d1"), (F.lead("y").over(_w()) - 2 * F.col("y") + F.lag("y").over(_w())).alias("d2"))


def central_slope(df: DataFrame) -> DataFrame:
    """(series, t, slope): (y after - y before) / (t after - t before), one-sided at the ends."""
    up, low = F.coalesce(F.lead("y").over(_w()), F.col("y")), F.coalesce(F.lag("y").over(_w()), F.col("y"))
    tu, tl = F.coalesce(F.lead("t").over(_w()), F.col("t")), F.coalesce(F.lag("t").over(_w()), F.col("t"))
    return df.select("series", "t", up.alias("u"), low.alias("l"), tu.alias("tu"), tl.alias("tl")).select("series", "t", F.when(F.col("tu") > F.col("tl"), (F.col("u") - F.col("l")) / (F.col("tu") - F.col("tl"))).otherwise(0.0).alias("slope"))


def integral(df: DataFrame) -> DataFrame:
    """(series, area): trapezoids."""
    step = (F.col("y") + F.lag("y").over(_w())) / 2 * (F.col("t") - F.lag("t").over(_w()))
    return df.select("series", step.alias("a")).groupBy("series").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("area"))


def peak(df: DataFrame) -> DataFrame:
    """(series, peak_t, peak_y): the greatest value, leftmost on ties."""
    return df.groupBy("series").agg(F.min_by("t", F.struct(-F.col("y"), "t")).alias("peak_t"), F.max("y").alias("peak_y"))


def half_life(df: DataFrame) -> DataFrame:
    """(series, half_t): first crossing of half the peak after it, interpolated; null if none."""
    p = peak(df)
    after = df.select("series", "t", "y", F.lag("t").over(_w()).alias("t0"), F.lag("y").over(_w()).alias("y0")).join(p, "series").where("t > peak_t and y <= peak_y / 2 and y0 > peak_y / 2")
    at = F.col("t0") + (F.col("y0") - F.col("peak_y") / 2) / (F.col("y0") - F.col("y")) * (F.col("t") - F.col("t0"))
    found = after.groupBy("series").agg(F.min_by(at, "t").alias("half_t"))
    return p.select("series").join(found, "series", "left")


def slope(df: DataFrame) -> DataFrame:
    """(series, n, slope, r2): least squares of y on t."""
    return df.groupBy("series").agg(F.count("*").alias("n"), F.regr_slope("y", "t").alias("slope"), F.regr_r2("y", "t").alias("r2"))


def log_log_fit(df: DataFrame) -> DataFrame:
    """(series, slope, r2) of ln y on ln t, over positive values."""
    return df.where("t > 0 and y > 0").groupBy("series").agg(F.regr_slope(F.log("y"), F.log("t")).alias("slope"), F.regr_r2(F.log("y"), F.log("t")).alias("r2"))


def regime_changes(df: DataFrame, span: int = 8, z: float = 2.0) -> DataFrame:
    """(series, t, z): differences that stand ``z`` deviations off the previous ``span`` ones."""
    past = _w().rowsBetween(-span, -1)
    d = df.select("series", "t", (F.col("y") - F.lag("y").over(_w())).alias("d")).where("d is not null")
    scored = d.select("series", "t", "d", F.avg("d").over(past).alias("m"), F.stddev_pop("d").over(past).alias("s"), F.count("d").over(past).alias("n"))
    return scored.where((F.col("n") == span) & (F.col("s") > 0)).select("series", "t", ((F.col("d") - F.col("m")) / F.col("s")).alias("z")).where(F.abs("z") >= z)


def ar2(df: DataFrame, ridge: float = 1e-9) -> DataFrame:
    """(series, n, a1, a2): ridge least squares of y on its two predecessors, by Cramer's rule."""
    rows = df.select("series", "y", F.lag("y", 1).over(_w()).alias("p"), F.lag("y", 2).over(_w()).alias("q")).where("q is not null")
    s = rows.groupBy("series").agg(F.count("*").alias("n"), *(F.sum(F.col(x) * F.col(y)).alias(x + y) for x, y in ("pp", "pq", "qq", "py", "qy")))
    det = (F.col("pp") + ridge) * (F.col("qq") + ridge) - F.col("pq") * F.col("pq")
    return s.select("series", "n", ((F.col("py") * (F.col("qq") + ridge) - F.col("qy") * F.col("pq")) / det).alias("a1"), ((F.col("qy") * (F.col("pp") + ridge) - F.col("py") * F.col("pq")) / det).alias("a2"))


def forecast(df: DataFrame, last: int = 12, ahead: int = 1) -> DataFrame:
    """(series, forecast): a line through the last values, extended."""
    back = Window.partitionBy("series").orderBy(F.col("t").desc())
    x = df.where(F.col("y").isNotNull() & ~F.isnan("y")).withColumn("k", -F.row_number().over(back)).where(F.col("k") >= -last)
    return x.groupBy("series").agg((F.regr_intercept("y", "k") + F.regr_slope("y", "k") * (ahead - 1)).alias("forecast"))


def path_speed(df: DataFrame, span: int = 5) -> DataFrame:
    """(series, t, speed): mean size of the last steps."""
    step = df.select("series", "t", F.abs(F.col("y") - F.lag("y").over(_w())).alias("d"))
    return step.select("series", "t", F.avg("d").over(_w().rowsBetween(1 - span, 0)).alias("speed"))


def transitions(df: DataFrame, label: str = "label") -> DataFrame:
    """(series, t, before, after): where a label changes."""
    return df.select("series", "t", F.lag(label).over(_w()).alias("before"), F.col(label).alias("after")).where("before <> after")


def autocorrelation_length(df: DataFrame, cap: int = 32) -> DataFrame:
    """(series, length): the first lag whose centred autocorrelation is not positive."""
    mean = Window.partitionBy("series")
    c = df.select("series", F.row_number().over(_w()).alias("k"), (F.col("y") - F.avg("y").over(mean)).alias("c"), F.count("*").over(mean).alias("n"))
    lagged = c.select("series", F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("lag"), F.col("k"), F.col("c").alias("c2"), "n").where("lag <= n div 2").select("series", "lag", (F.col("k") + F.col("lag")).alias("k"), "c2")
    products = c.join(lagged, ["series", "k"]).groupBy("series", "lag").agg(F.sum(F.col("c") * F.col("c2")).alias("r"))
    first = products.where("r <= 0").groupBy("series").agg(F.min("lag").alias("first"))
    base = c.groupBy("series").agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col("c")).alias("v"))
    length = F.when((F.col("n") < 4) | (F.col("v") <= 0), 4).otherwise(F.greatest(F.lit(2), F.coalesce("first", F.least(F.lit(cap), F.expr("n div 2")))))
    return base.join(first, "series", "left").select("series", length.cast("long").alias("length"))


def knee(df: DataFrame) -> DataFrame:
    """(series, knee_t, distance): the point farthest from the chord between first and last."""
    ends = df.groupBy("series").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.min_by("y", "t").alias("y0"), F.max_by("y", "t").alias("y1"))
    gap = F.abs((F.col("y1") - F.col("y0")) * (F.col("t") - F.col("t0")) - (F.col("t1") - F.col("t0")) * (F.col("y") - F.col("y0"))) / F.sqrt(F.pow(F.col("y1") - F.col("y0"), 2) + F.pow(F.col("t1") - F.col("t0"), 2))
    return df.join(ends, "series").where("t1 > t0").select("series", "t", gap.alias("g")).groupBy("series").agg(F.min_by("t", F.struct(-F.col("g"), "t")).alias("knee_t"), F.max("g").alias("distance"))


def max_gap(df: DataFrame) -> DataFrame:
    """(series, gap_t, gap): the largest step to the next value."""
    step = df.select("series", "t", (F.lead("y").over(_w()) - F.col("y")).alias("g")).where("g is not null")
    return step.groupBy("series").agg(F.min_by("t", F.struct(-F.col("g"), "t")).alias("gap_t"), F.max("g").alias("gap"))


def sample_at(df: DataFrame, at: DataFrame) -> DataFrame:
    """(series, at, y): values at other places, linear in ln t between samples, clamped at the ends.

    An as-of join by one ordered pass: samples and places are merged, and each place looks back and
    ahead for the nearest samples.
    """
    rows = df.select("series", F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"), F.lit(0).alias("ask")).unionByName(at.select("series", F.col("at").cast("double").alias("t"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("ask")))
    order = Window.partitionBy("series").orderBy("t", "ask")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("ask") == 0, F.struct("t", "y"))
    near = rows.select("series", "t", "ask", F.last(point, True).over(back).alias("a"), F.first(point, True).over(ahead).alias("b")).where("ask = 1")
    share = (F.log("t") - F.log("a.t")) / (F.log("b.t") - F.log("a.t"))
    value = F.when(F.col("a").isNull(), F.col("b.y")).when(F.col("b").isNull() | (F.col("a.t") == F.col("b.t")) | (F.col("a.t") == F.col("t")), F.col("a.y")).otherwise(F.col("a.y") + (F.col("b.y") - F.col("a.y")) * share)
    return near.select("series", F.col("t").alias("at"), value.alias("y"))


def moments(df: DataFrame) -> DataFrame:
    """(series, centre, spread): mean and variance of t weighted by |y|."""
    w = F.abs("y")
    return df.groupBy("series").agg(F.sum(w).alias("w"), F.sum(w * F.col("t")).alias("s1"), F.sum(w * F.col("t") * F.col("t")).alias("s2")).where("w > 0").select("series", (F.col("s1") / F.col("w")).alias("centre"), (F.col("s2") / F.col("w") - F.pow(F.col("s1") / F.col("w"), 2)).alias("spread"))


def spectrum(df: DataFrame) -> DataFrame:
    """(series, k, magnitude): DFT magnitudes of each series, for k up to half its length."""
    n = F.count("*").over(Window.partitionBy("series"))
    rows = df.select("series", (F.row_number().over(_w()) - 1).alias("j"), "y", n.alias("n"))
    angle = -2 * 3.141592653589793 * F.col("k") * F.col("j") / F.col("n")
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.expr("n div 2"))).alias("k"))
    return each.groupBy("series", "k").agg(F.sum(F.col("y") * F.cos(angle)).alias("re"), F.sum(F.col("y") * F.sin(angle)).alias("im")).select("series", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))


def consecutive_jaccard(df: DataFrame, members: str = "members") -> DataFrame:
    """(series, t, jaccard) of each set with the one before; two empty sets have 0."""
    pair = df.select("series", "t", F.col(members).alias("m"), F.lag(members).over(_w()).alias("p")).where("p is not null")
    union = F.size(F.array_union("m", "p"))
    return pair.select("series", "t", F.when(union > 0, F.size(F.array_intersect("m", "p")) / union).otherwise(0.0).alias("jaccard"))


def orbit(df: DataFrame, threshold: float = 0.015, least: int = 6) -> DataFrame:
    """(series, n, slope, label): converging, diverging or steady by the slope; short ones unknown."""
    s = df.groupBy("series").agg(F.count("*").alias("n"), F.regr_slope("y", "t").alias("slope"))
    return s.withColumn("label", F.when(F.col("n") < least, "unknown").when(F.col("slope") < -threshold, "converging").when(F.col("slope") > threshold, "diverging").otherwise("steady"))


def classify(df: DataFrame) -> DataFrame:
    """(series, cv, tau, kind): invariant if stddev / |mean| < 0.10, running if nearly all pairs
    agree in direction, else artifact.  Pairs are within a curve."""
    stats = df.groupBy("series").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    cv = F.when(F.col("m") != 0, F.col("s") / F.abs("m")).otherwise(F.when(F.col("s") > 0, F.lit(1e9)).otherwise(0.0))
    curve = df.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("c"))
    signs = F.aggregate(
        F.transform("c", lambda x, i: F.aggregate(F.slice(F.col("c"), i + 2, F.size("c")), F.lit(0.0), lambda a, z: a + F.signum(z["y"] - x["y"]))), F.lit(0.0), lambda a, x: a + x)
    tau = curve.select("series", F.when(F.size("c") > 1, signs / (F.size("c") * (F.size("c") - 1) / 2)).otherwise(0.0).alias("tau"))
    return stats.join(tau, "series").select("series", cv.alias("cv"), "tau").withColumn("kind", F.when(F.col("cv") < 0.10, "invariant").when(F.abs("tau") >= 0.8, "running").otherwise("artifact"))
