"""Maximum spanning forest, and single-link clusters at any threshold as cuts of it.

The forest is found by rounds in which every component takes its heaviest edge to another one
(ties: the lesser pair); the edges taken are acyclic, and each round at least halves the number of
components.  Components that meet point to one another along these edges, and pointers are doubled
to their roots.  Between two components only the heaviest edge is kept, so edges shrink as fast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coupling import coherence
from .graph import components, cut
from .ordering import numbered


def _roots(taken: DataFrame) -> DataFrame:
    """(c, root) of pointers (c, o) whose only cycles are pairs that point to each other."""
    back = taken.select(F.col("c").alias("o"), F.col("o").alias("back"))
    now = cut(taken.join(back, "o").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("root")))
    while True:
        onward = now.select(F.col("c").alias("root"), F.col("root").alias("onward"))
        stepped = cut(now.join(onward, "root").select("c", F.col("onward").alias("root"), (F.col("onward") != F.col("root")).alias("moved")))
        now = stepped.drop("moved")
        if not stepped.where("moved").take(1):
            return now


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the maximum spanning forest of undirected edges (a, b, w).

    Loops, null ends and null or NaN weights are left out; of repeated edges the heaviest counts.
    """
    ok = F.col("w").isNotNull() & ~F.isnan("w") & (F.col("a") != F.col("b"))
    one = edges.where(ok).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("w").alias("w"))
    live, found = cut(one.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct((-F.col("w")).alias("w"), "a", "b").alias("e"))), []
    while True:
        way = lambda x, y: F.struct(F.col(x).alias("c"), F.col(y).alias("o"), F.col("e").alias("e"))
        ends = live.select(F.inline(F.array(way("ca", "cb"), way("cb", "ca"))))
        taken = cut(ends.groupBy("c").agg(F.min(F.struct("e", "o")).alias("best")).select("c", "best.o", "best.e"))
        if not taken.take(1):
            break
        found.append(taken.select("e.a", "e.b", (-F.col("e.w")).alias("w")).distinct())
        root = _roots(taken.select("c", "o"))
        moved = live.join(root.select(F.col("c").alias("ca"), F.col("root").alias("ra")), "ca").join(root.select(F.col("c").alias("cb"), F.col("root").alias("rb")), "cb").where("ra <> rb")
        live = cut(moved.groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")).agg(F.min("e").alias("e")))
    return reduce(DataFrame.union, found) if found else one


def single_link(forest: DataFrame, threshold: float) -> DataFrame:
    """(node, root): components of the forest's edges of at least ``threshold``; root is the least node."""
    return components(forest.where(F.col("w") >= threshold))


def sweep(edges: DataFrame, thresholds: list[float], n_nodes: int) -> DataFrame:
    """(threshold, components, largest_share, cycle_rank) of the edges at each threshold.

    All thresholds are cuts of one forest: from the highest down, each adds the forest's edges of its
    band to the components so far, so every edge of the forest is used once.
    """
    kept = cut(edges.where(F.col("w") >= min(thresholds)))
    forest, labels, rows, above = cut(spanning_forest(kept)), None, {}, None
    for low in sorted(set(thresholds), reverse=True):
        band = forest.where(F.col("w") >= low) if above is None else forest.where((F.col("w") >= low) & (F.col("w") < above))
        if labels is not None:
            for side in ("a", "b"):
                band = band.join(labels.select(F.col("node").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        new = components(band.select("a", "b"))
        if labels is not None:
            onward = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
            carried = labels.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            new = carried.union(new.join(labels.select("node"), "node", "left_anti"))
        labels, above = cut(new), low
        sizes = labels.groupBy("root").agg(F.count("*").alias("n")).agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("covered"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
        m = kept.where(F.col("w") >= low).agg(F.count("*").alias("m"))
        whole = F.col("c") + F.lit(n_nodes) - F.col("covered")
        share = F.greatest("largest", F.lit(1 if n_nodes else 0)) / max(1, n_nodes)
        rows[low] = sizes.crossJoin(m).select(F.lit(float(low)).alias("threshold"), whole.alias("components"), share.alias("largest_share"), (F.col("m") - n_nodes + whole).alias("cycle_rank"))  # one row each
    return reduce(DataFrame.union, [rows[x] for x in thresholds])


#: Axes from the strongest tie-break down; the first four bind a pair on their own.
AXES = ("spectral", "transport", "hunk", "co_change", "symbol", "path")
STRONG, FREE = AXES[:4], ("transport", "spectral")


def adaptive_threshold(edges: DataFrame, members: DataFrame, low: float = 0.15, high: float = 0.50, default: float = 0.25) -> float:
    """The mean score (a, b, score) among ``members`` (one column ``item``), kept in a band."""
    inner = edges.join(members.select(F.col("item").alias("a")), "a", "left_semi").join(members.select(F.col("item").alias("b")), "b", "left_semi")
    mean = inner.agg(F.avg("score")).first()[0]
    return min(high, max(low, default if mean is None else mean))


def clusters(members: DataFrame, edges: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(item, cluster, size, tightness, axis): single-link clusters of ``members`` (one column ``item``).

    ``pairs``: (a, b, score, axis) with an axis of ``AXES``.  A pair counts if its score reaches the
    threshold (any positive score for the ``FREE`` axes) and an axis that binds, or two axes, speak for
    it; it is as strong as its best axis.  Clusters are numbered by tightness in hundredths (mean score
    of ``edges`` (a, b, score) over their pairs), size and least item; items alone are cluster -1.  A
    cluster's axis is the one with most score among its pairs.
    """
    items = members.select("item").distinct()
    prior = F.array_position(F.lit(list(AXES)), F.col("axis"))
    own = pairs.where((F.col("score") >= threshold) | (F.col("axis").isin(*FREE) & (F.col("score") > 0))).where("a <> b")
    own = own.join(items.select(F.col("item").alias("a")), "a", "left_semi").join(items.select(F.col("item").alias("b")), "b", "left_semi")
    best = own.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.max("score").alias("w"), F.min_by("axis", F.struct(-F.round("score", 9), prior)).alias("axis"), F.bool_or(F.col("axis").isin(*STRONG)).alias("strong"), F.count_distinct("axis").alias("n")
    )
    bound = cut(best.where("strong or n >= 2").select("a", "b", "w", "axis"))
    roots = cut(components(spanning_forest(bound.select("a", "b", "w")).select("a", "b")))
    tight = coherence(edges, roots.select(F.col("root").alias("set_id"), F.col("node").alias("item")))
    votes = bound.join(roots.select(F.col("node").alias("a"), "root"), "a").groupBy("root", "axis").agg(F.sum("w").alias("s"))
    axis = votes.groupBy("root").agg(F.min_by("axis", F.struct(-F.round("s", 9), prior)).alias("axis"))
    each = tight.select(F.col("set_id").alias("root"), "size", F.col("coherence").alias("tightness")).join(axis, "root")
    order = [F.round(F.round("tightness", 9) * 100).desc(), F.desc("size"), F.col("root")]
    named = numbered(each, order, "cluster")
    return items.join(roots.withColumnRenamed("node", "item").join(named, "root"), "item", "left").select(
        "item", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("tightness", F.lit(0.0)).alias("tightness"), F.coalesce("axis", F.lit("")).alias("axis")
    )
