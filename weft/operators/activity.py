"""Activity of items and actors over time: decay, heat, life cycles, cadence, experts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("double")


def touches(rows: DataFrame, item: str, actor: str, at: str) -> DataFrame:
    """(item, touches, actors, first_at, last_at, last_actor)."""
    return rows.groupBy(F.col(item).alias("item")).agg(
        F.count("*").alias("touches"),
        F.count_distinct(actor).alias("actors"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.max_by(actor, F.struct(F.col(at), F.col(actor))).alias("last_actor"),
    )


def alive_mass(touched: DataFrame, now: Column, half_life: float) -> DataFrame:
    """(item, touches, alive): touches * exp(-age / half_life)."""
    return touched.select("item", "touches", (F.col("touches") * F.exp(-days_between(now, F.col("last_at")) / half_life)).alias("alive"))


def recent_weights(rows: DataFrame, item: str, at: str, now: Column, half_life: float = 30.0, cut: float = 6.0) -> DataFrame:
    """(item, weight): sum of 2^(-age / half_life) over touches of at most ``cut`` half-lives."""
    age = days_between(now, F.col(at))
    return rows.where(age <= cut * half_life).groupBy(F.col(item).alias("item")).agg(F.sum(F.exp(-age * math.log(2) / half_life)).alias("weight"))


def heat(rows: DataFrame, item: str, at: str, key: str, now: Column, newest: int = 20, window_days: int = 365, scale: float = 14.0) -> DataFrame:
    """(item, heat): min(1, sum of exp(-age / scale)) over each item's newest touches in the window."""
    order = Window.partitionBy(item).orderBy(F.col(at).desc(), F.col(key).desc())
    recent = rows.where(days_between(now, F.col(at)) <= window_days).withColumn("n", F.row_number().over(order)).where(F.col("n") <= newest)
    return recent.groupBy(F.col(item).alias("item")).agg(F.least(F.lit(1.0), F.sum(F.exp(-days_between(now, F.col(at)) / scale))).alias("heat"))


def quantile_cuts(df: DataFrame, column: str, *shares: float) -> DataFrame:
    """One row (cut0, cut1, ..): the values at index floor(share * n) of the ascending order.

    They come from a histogram of the distinct values, which a running sum orders; rows are not.
    """
    hist = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    order = Window.orderBy("x")
    hist = hist.select("x", F.sum("n").over(order).alias("upto"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    at = [F.least(F.col("all") - 1, F.floor(F.round(F.col("all") * share, 6))) for share in shares]
    return hist.agg(*(F.min(F.when(F.col("upto") > k, F.col("x"))).alias(f"cut{i}") for i, k in enumerate(at)))


def lifecycles(alive: DataFrame, high: float = 0.90, mid: float = 0.70) -> DataFrame:
    """(item, touches, alive, stage) by quantiles of touches and the share still alive."""
    cuts = F.broadcast(quantile_cuts(alive, "touches", high, mid))
    share = F.col("alive") / F.col("touches")
    stage = (
        F.when((F.col("touches") >= F.col("cut0")) & (share >= 0.4), "keystone")
        .when(share >= 0.7, "active")
        .when(share >= 0.4, F.when(F.col("touches") >= F.col("cut1"), "stable").otherwise("warm"))
        .when(share >= 0.15, "cooling")
        .otherwise("dormant")
    )
    return alive.crossJoin(cuts).select("item", "touches", "alive", stage.alias("stage"))  # with one row


def daily_counts(rows: DataFrame, at: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


def gap_filled(daily: DataFrame) -> DataFrame:
    """(day, n) with zero days between the first and the last."""
    span = daily.agg(F.min("day").alias("low"), F.max("day").alias("high")).where(F.col("low").isNotNull())
    days = span.select(F.explode(F.sequence("low", "high")).alias("day"))
    return days.join(daily, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bursts(daily: DataFrame, k: int = 3) -> DataFrame:
    """(day, n): the busiest days."""
    return daily.orderBy(F.col("n").desc(), "day").limit(k)


def gaps(daily: DataFrame, k: int = 2, *keys: str) -> DataFrame:
    """(keys, day, gap_days): the first ``k`` days after more than a day of silence, for each of the keys.

    One row per day with activity, so an ordered window is over a calendar, not over the data.
    """
    order = Window.partitionBy(*keys).orderBy("day") if keys else Window.orderBy("day")
    late = daily.select(*keys, "day", F.datediff(F.col("day"), F.lag("day").over(order)).alias("gap_days")).where("gap_days > 1")
    return late.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def experts(rows: DataFrame, item: str, actor: str, at: str, key: str, newest: int = 50, k: int = 5) -> DataFrame:
    """(item, actor, touches, share): who made most of an item's newest touches."""
    order = Window.partitionBy(item).orderBy(F.col(at).desc(), F.col(key).desc())
    recent = rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= newest)
    counted = recent.groupBy(F.col(item).alias("item"), F.col(actor).alias("actor")).agg(F.count("*").alias("touches"))
    total = F.sum("touches").over(Window.partitionBy("item"))
    best = Window.partitionBy("item").orderBy(F.col("touches").desc(), "actor")
    return counted.select("item", "actor", "touches", (F.col("touches") / total).alias("share"), F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)


def pivots(rows: DataFrame, txn: str, item: str, mass: str, k: int = 6) -> DataFrame:
    """(txn, items, churn): the transactions with most items, then churn."""
    sized = rows.groupBy(F.col(txn).alias("txn")).agg(F.count_distinct(item).alias("items"), F.sum(mass).alias("churn"))
    return sized.orderBy(F.col("items").desc(), F.col("churn").desc(), "txn").limit(k)


def ewma(rows: DataFrame, item: str, value: str, order: list[str], rate: float = 1 - 2 ** (-1 / 90)) -> DataFrame:
    """(item, ewma): a fold from oldest to newest, from zero, by each value's closed weight."""
    after = F.row_number().over(Window.partitionBy(item).orderBy(*(F.desc(c) for c in order), F.desc(value))) - 1
    weighed = rows.select(F.col(item).alias("item"), (F.col(value).cast("double") * rate * F.pow(F.lit(1 - rate), after)).alias("x"))
    return weighed.groupBy("item").agg(F.sum("x").alias("ewma"))


def z_scores(df: DataFrame, item: str, value: str) -> DataFrame:
    """(item, value, z) against the global mean and sample deviation, both one row."""
    stats = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    z = F.when(F.col("s") > 0, (F.col(value) - F.col("m")) / F.col("s")).otherwise(0.0)
    return df.crossJoin(F.broadcast(stats)).select(F.col(item).alias("item"), F.col(value).alias("value"), z.alias("z"))


def integrity(df: DataFrame, item: str, cue: str, n: str, prior: float = 0.85) -> DataFrame:
    """(item, integrity): a cue shrunk to the prior; tau is the touches at index n / 4."""
    cuts = F.broadcast(quantile_cuts(df, n, 0.25))  # one row
    keep = 1 - F.exp(-F.col(n) / F.greatest(F.lit(1.0), F.col("cut0").cast("double")))
    return df.crossJoin(cuts).select(F.col(item).alias("item"), (F.lit(prior) + (F.col(cue) - prior) * keep).alias("integrity"))


def ancestors(rows: DataFrame, path: str, mass: str, separator: str = "/") -> DataFrame:
    """(prefix, depth, mass): mass rolled up to every ancestor of a path, the root "" included."""
    parts = F.split(path, separator)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), separator))
    return rows.select(F.posexplode(prefixes).alias("depth", "prefix"), F.col(mass).alias("m")).groupBy("prefix", "depth").agg(F.sum("m").alias("mass"))


def meaning(rows: DataFrame, actor: Column, subject: Column, ritual_share: Column, source_like: Column, n_paths: Column, lines: Column) -> DataFrame:
    """Adds ``meaning`` in [0, 1]: a product of factors for bots, check points, clerical work,
    ritual paths and wide shallow changes."""
    phi = (1 + 5**0.5) / 2
    who, what = F.lower(actor), F.lower(subject)
    m = (
        F.when(who.contains("bot"), 0.45).otherwise(1.0)
        * F.when(what.rlike("checkpoint|wip"), 0.2).otherwise(1.0)
        * F.when(what.rlike("bump|format|rename|typo|merge"), 0.6).otherwise(1.0)
        * F.when(ritual_share > 1 / phi**2, F.exp(-(ritual_share - 1 / phi**2))).otherwise(1.0)
    )
    m = F.when(source_like, F.greatest(m, F.lit(0.55))).otherwise(m)
    return rows.withColumn("meaning", m * F.when((n_paths >= 8) & (lines / n_paths < phi**2), 0.382).otherwise(1.0))


def telemetry(samples: DataFrame, keys: list[str], value: str, failed: Column, at: str, key: str) -> DataFrame:
    """(keys, n, failures, p50, p95, last_value, last_at): nearest-rank percentiles."""
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(failed).alias("failures"),
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("p50"),
        F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"),
        F.max_by(value, F.struct(at, key)).alias("last_value"),
        F.max(at).alias("last_at"),
    )


def entropy(rows: DataFrame, group: str, category: str) -> DataFrame:
    """(grp, kinds, entropy): Shannon entropy over ln(kinds); one kind has 0."""
    counted = rows.groupBy(F.col(group).alias("grp"), category).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("grp"))
    return counted.withColumn("p", p).groupBy("grp").agg(F.count("*").alias("kinds"), (-F.sum(F.col("p") * F.log("p"))).alias("h")).select("grp", "kinds", F.when(F.col("kinds") > 1, F.col("h") / F.log("kinds")).otherwise(0.0).alias("entropy"))


def smoothed_acceptance(rows: DataFrame, group: str, accepted: Column) -> DataFrame:
    """(grp, accepted, rejected, rate): (a + 1) / (a + r + 2)."""
    counted = rows.groupBy(F.col(group).alias("grp")).agg(F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"))
    return counted.withColumn("rate", (F.col("accepted") + 1) / (F.col("accepted") + F.col("rejected") + 2))


def shrunk_means(rows: DataFrame, bucket: str, value: str, prior: float, weight: float) -> DataFrame:
    """(bucket, n, mean): bucket means drawn to a prior of ``weight`` observations."""
    return rows.groupBy(F.col(bucket).alias("bucket")).agg(F.count(value).alias("n"), ((F.sum(value) + prior * weight) / (F.count(value) + weight)).alias("mean"))


def retained(samples: DataFrame, at: str, size: str, now: Column, days: int, budget: int) -> DataFrame:
    """The newest samples of at most ``days`` days whose sizes, newest first, stay in ``budget``.

    Sizes are summed by day first; only the day in which the budget ends is ordered row by row.
    """
    fresh = samples.where(days_between(now, F.col(at)) <= days).withColumn("__day", F.to_date(at))
    daily = fresh.groupBy("__day").agg(F.sum(size).alias("__s"))
    before = daily.select("__day", "__s", F.coalesce(F.sum("__s").over(Window.orderBy(F.col("__day").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    kept = fresh.join(F.broadcast(before), "__day").where(F.col("__before") < budget)
    within = F.sum(size).over(Window.partitionBy("__day").orderBy(F.col(at).desc(), F.col(size)))
    return kept.withColumn("__run", F.col("__before") + within).where(F.col("__run") <= budget).select(*samples.columns)
