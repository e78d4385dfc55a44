"""Graph operators over edge tables: (a, b, w) undirected, (src, dst, w) from both sides.

Iterations are driver loops of DataFrame steps.  ``cut`` writes a step as a table in the shared folder
of ``spark.checkpoint.dir``, so that lineage does not grow and a lost executor costs no earlier step.
A step is computed once, and the shuffle files behind it go as soon as its table is complete.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: While a table is written, Spark deletes its shuffle files at its end, not when the driver collects garbage.
WHILE_WRITING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """A new folder in that of ``spark.checkpoint.dir``, which on one machine is made if it is not set."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/weft-{uuid.uuid4().hex}"


@contextmanager
def _writing(spark: SparkSession):
    before = spark.conf.get(WHILE_WRITING, None)
    spark.conf.set(WHILE_WRITING, "true")
    try:
        yield
    finally:
        spark.conf.unset(WHILE_WRITING) if before is None else spark.conf.set(WHILE_WRITING, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own."""
    spark = df.sparkSession
    path = folder(spark)
    with _writing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def laid(df: DataFrame, partitions: int, key: str) -> DataFrame:
    """``df`` as a table in ``partitions`` buckets sorted by ``key``; joins and sums by ``key`` need no shuffle."""
    spark = df.sparkSession
    name = f"weft_{uuid.uuid4().hex}"
    path = folder(spark)
    with _writing(spark):
        df.repartition(partitions, key).write.bucketBy(partitions, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def drop(df: DataFrame) -> None:
    """Delete a table of ``cut`` or ``laid`` that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in {f.rpartition("/")[0] for f in df.inputFiles()[:1]}:
        if "/weft-" in path:
            at = hadoop.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: self-loops, nulls and weights that are not positive and finite go,
    repeated edges are summed."""
    ok = F.col("w").isNotNull() & ~F.isnan("w") & (F.col("w") > 0) & (F.col("w") < float("inf")) & (F.col("a") != F.col("b"))
    return edges.where(ok).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))


def both(edges: DataFrame) -> DataFrame:
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.col("w").alias("w"))
    return edges.select(F.inline(F.array(way("a", "b"), way("b", "a"))))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength)."""
    return both(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def normalised(edges: DataFrame) -> DataFrame:
    """(src, dst, w): D^-1/2 W D^-1/2 from both sides."""
    d = degrees(edges).select("node", "strength")
    s = both(edges).join(d.select(F.col("node").alias("src"), F.col("strength").alias("x")), "src").join(d.select(F.col("node").alias("dst"), F.col("strength").alias("y")), "dst")
    return s.select("src", "dst", (F.col("w") / F.sqrt(F.col("x") * F.col("y"))).alias("w"))


def times(norm: DataFrame, field: DataFrame) -> DataFrame:
    """(node, v): the normalised matrix times a field (node, v)."""
    return norm.join(field.select(F.col("node").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def bessel_coefficients(t: float, k: int = 20, tail: float = 1e-8) -> list[float]:
    """e^-t I_j(t) for j = 0.., doubled beyond 0, up to the last one above the tail."""
    out = []
    for j in range(k + 1):
        term = total = (t / 2) ** j / math.factorial(j)
        m = 1
        while term > 1e-18 * max(total, 1e-300) and m < 400:
            term *= (t / 2) ** 2 / (m * (m + j))
            total += term
            m += 1
        out.append(math.exp(-t) * total * (1 if j == 0 else 2))
    while len(out) > 2 and out[-1] < tail:
        out.pop()
    return out


def heat(edges: DataFrame, sources: DataFrame, t: float = 1.0, k: int = 20) -> DataFrame:
    """(node, phi): exp(-tL) of the sources' masses (node, mass; scaled to sum 1), by Chebyshev.

    L = I - N, so exp(-tL) = exp(-t) exp(tN), a sum of Chebyshev polynomials of N with Bessel
    coefficients.  Every third step is cut.
    """
    norm = cut(normalised(clean(edges)))
    total = sources.agg(F.sum("mass").alias("s"))
    rho = sources.crossJoin(F.broadcast(total)).groupBy("node").agg((F.sum("mass") / F.first("s")).alias("v"))
    c = bessel_coefficients(t, k)
    before, now = rho, times(norm, rho)
    out = rho.select("node", (F.col("v") * c[0]).alias("v")).union(now.select("node", (F.col("v") * c[1]).alias("v")))
    for j in range(2, len(c)):
        stepped = times(norm, now).select("node", (2 * F.col("v")).alias("v")).union(before.select("node", (-F.col("v")).alias("v")))
        before, now = now, stepped.groupBy("node").agg(F.sum("v").alias("v"))
        if j % 3 == 0:
            before, now = cut(before), cut(now)
        out = out.union(now.select("node", (F.col("v") * c[j]).alias("v")))
    return out.groupBy("node").agg(F.sum("v").alias("phi"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): least node of each component, by alternating large and small stars."""
    links = cut(edges.select("a", "b").where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        s = links.union(links.select("b", "a"))
        m = s.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = s.join(m, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        links = cut(large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = after
    raise RuntimeError("components did not settle")


def fragmentation(edges: DataFrame, threshold: float, n_nodes: int) -> DataFrame:
    """(components, largest_share, cycle_rank) of the edges of at least the threshold."""
    kept = cut(edges.where(F.col("w") >= threshold).select("a", "b"))
    roots = components(kept)
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    s = sizes.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("covered"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    e = kept.agg(F.count("*").alias("m"))
    isolated = F.lit(n_nodes) - F.col("covered")
    return s.crossJoin(e).select((F.col("c") + isolated).alias("components"), (F.greatest("largest", F.lit(1 if n_nodes else 0)) / max(1, n_nodes)).alias("largest_share"), (F.col("m") - n_nodes + F.col("c") + isolated).alias("cycle_rank"))


def fragmentation_curve(edges: DataFrame, thresholds: list[float], n_nodes: int) -> DataFrame:
    """(threshold, components, largest_share, cycle_rank) at each given threshold: cuts of one forest."""
    from .forest import sweep

    return sweep(edges, thresholds, n_nodes)


def coarsen(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, w): cross-group weights summed, inner ones dropped.  ``groups``: (node, grp)."""
    g = edges.join(groups.select(F.col("node").alias("a"), F.col("grp").alias("ga")), "a").join(groups.select(F.col("node").alias("b"), F.col("grp").alias("gb")), "b").where("ga <> gb")
    return g.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum("w").alias("w"))


def stationary(edges: DataFrame) -> DataFrame:
    """(node, p): strength over total strength."""
    d = degrees(edges)
    return d.crossJoin(F.broadcast(d.agg(F.sum("strength").alias("s")))).select("node", (F.col("strength") / F.col("s")).alias("p"))


def gradient(edges: DataFrame, field: DataFrame) -> DataFrame:
    """(a, b, d): differences of a field along edges, times the root of the weight."""
    f = field.select("node", "v")
    return edges.join(f.select(F.col("node").alias("a"), F.col("v").alias("x")), "a").join(f.select(F.col("node").alias("b"), F.col("v").alias("y")), "b").select("a", "b", (F.sqrt("w") * (F.col("y") - F.col("x"))).alias("d"))


def divergence(edges: DataFrame, flow: DataFrame) -> DataFrame:
    """(node, v): what a flow (a, b, d) brings to each node."""
    f = edges.join(flow, ["a", "b"]).select("a", "b", (F.sqrt("w") * F.col("d")).alias("x"))
    return f.select(F.col("b").alias("node"), F.col("x").alias("x")).union(f.select(F.col("a").alias("node"), (-F.col("x")).alias("x"))).groupBy("node").agg(F.sum("x").alias("v"))


def transport(arcs: DataFrame) -> DataFrame:
    """(src, dst, flow): (T - T') / 2 of directed weights, positive side only."""
    signed = arcs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") < F.col("dst"), F.col("w")).otherwise(-F.col("w")).alias("w")).where("a <> b")
    net = signed.groupBy("a", "b").agg((F.sum("w") / 2).alias("f")).where("f <> 0")
    up = F.col("f") > 0
    return net.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("dst"), F.abs("f").alias("flow"))


def propagate_labels(edges: DataFrame, labels: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, label): labelled nodes keep theirs; others take the label of greatest weight around
    them, ties to the lesser label, for a number of rounds."""
    known = labels.select("node", "label")
    s = cut(both(edges))
    for _ in range(rounds):
        votes = s.join(known.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.round("w", 9), "label")).alias("label"))
        known = cut(labels.select("node", "label").union(best.join(labels.select(F.col("node").alias("src")), "src", "left_anti").select(F.col("src").alias("node"), "label")))
    return known


def new_node_scores(edges: DataFrame, phi: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, phi): scores of unseen nodes as weighted means over their known neighbours.
    ``arcs``: (node, other, w)."""
    return arcs.join(phi.select(F.col("node").alias("other"), "phi"), "other").groupBy("node").agg((F.sum(F.col("w") * F.col("phi")) / F.sum("w")).alias("phi"))


def attribution(axes: DataFrame, sources: DataFrame, t: float = 1.0) -> DataFrame:
    """(node, axis, phi, share): heat of each axis on its own; the share of the greatest.

    ``axes``: (axis, a, b, w); the number of axes is small, they are looped over.
    """
    names = [r[0] for r in axes.select("axis").distinct().orderBy("axis").collect()]
    parts = [heat(axes.where(F.col("axis") == name).select("a", "b", "w"), sources, t).select("node", F.lit(name).alias("axis"), "phi") for name in names]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    total = F.sum("phi").over(Window.partitionBy("node"))
    order = Window.partitionBy("node").orderBy(F.round("phi", 9).desc(), "axis")
    return whole.withColumns({"share": F.col("phi") / total, "r": F.row_number().over(order)}).where("r = 1").drop("r")
