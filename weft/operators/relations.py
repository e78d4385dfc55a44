"""What lies between items: scores with a fallback, neighbourhoods, edits of a graph, merged work, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import path_affinity, shared_prefix
from .coupling import both_ways
from .graph import cut


def combined_scores(edges: DataFrame, wanted: DataFrame, weight: str = "score") -> DataFrame:
    """(a, b, score) of wanted pairs: the edge's score; without an edge 0 if both items have edges,
    else the affinity of their paths.

    ``wanted``: (a, b, path_a, path_b) with a < b; ``edges``: one row a pair, a < b.
    """
    known = both_ways(edges, weight).where("w > 0").select(F.col("src").alias("item")).distinct()
    out = wanted.join(edges.select("a", "b", F.col(weight).alias("w")), ["a", "b"], "left")
    for side in ("a", "b"):
        out = out.join(known.select(F.col("item").alias(side), F.lit(True).alias(f"known_{side}")), side, "left")
    score = F.when(F.col("w") > 0, F.col("w")).when(F.col("known_a") & F.col("known_b"), 0.0).otherwise(path_affinity(F.col("path_a"), F.col("path_b")))
    return out.select("a", "b", score.alias("score"))


def with_symbol_edges(edges: DataFrame, symbols: DataFrame, weight: str = "score") -> DataFrame:
    """(src, dst, coupling, symbol): both sets of edges from both sides, 0 where one has no such edge."""
    c, s = both_ways(edges, weight).withColumnRenamed("w", "coupling"), both_ways(symbols, weight).withColumnRenamed("w", "symbol")
    return c.join(s, ["src", "dst"], "full").fillna(0.0, ["coupling", "symbol"])


def ghosts_within(live: DataFrame, shadow: DataFrame, sets: DataFrame, discount: float = 0.5, k: int = 10, weight: str = "score") -> DataFrame:
    """(set_id, a, b, score, effective): the k strongest shadow edges inside each set that no live edge has.

    ``sets``: (set_id, item).  Ties by a, b.
    """
    members = sets.select("set_id", "item").distinct()
    only = shadow.where(F.col(weight) > 0).join(live.where(F.col(weight) > 0).select("a", "b"), ["a", "b"], "left_anti")
    inside = only.join(members.withColumnRenamed("item", "a"), "a").join(members.withColumnRenamed("item", "b"), ["set_id", "b"])
    order = Window.partitionBy("set_id").orderBy(F.round(weight, 9).desc(), "a", "b")
    return inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("set_id", "a", "b", F.col(weight).alias("score"), (F.col(weight) * discount).alias("effective"))


def test_map(edges: DataFrame, seeds: DataFrame, tests: DataFrame, k: int = 15, weight: str = "score") -> DataFrame:
    """(item, score, anchor): the k tests most coupled to the least seed that they touch.

    ``seeds``: one column ``seed``; ``tests``: one column ``item``.
    """
    near = both_ways(edges, weight).join(seeds.select(F.col("seed").alias("src")).distinct(), "src").join(tests.select(F.col("item").alias("dst")).distinct(), "dst")
    first = near.groupBy(F.col("dst").alias("item")).agg(F.min_by("w", "src").alias("score"), F.min("src").alias("anchor"))
    return first.orderBy(F.round("score", 9).desc(), "item").limit(k)


def recent_near(edges: DataFrame, seeds: DataFrame, items: DataFrame, ranks: DataFrame, least: float = 0.2, most: int = 30, k: int = 10, weight: str = "score") -> DataFrame:
    """(seed, txn, nth): the k newest transactions that touch a seed or one of its nearest neighbours.

    A neighbourhood is the seed and its strongest neighbours above ``least``, ``most`` items in all.
    ``ranks``: (txn, rank), 0 the newest.
    """
    chosen = seeds.select("seed").distinct()
    near = both_ways(edges, weight).where(F.col("w") > least).join(chosen.withColumnRenamed("seed", "src"), "src")
    nearest = Window.partitionBy("src").orderBy(F.round("w", 9).desc(), "dst")
    near = near.withColumn("n", F.row_number().over(nearest)).where(F.col("n") < most).select(F.col("src").alias("seed"), F.col("dst").alias("item"))
    around = chosen.select("seed", F.col("seed").alias("item")).union(near)
    touched = around.join(items.select("txn", "item"), "item").select("seed", "txn").distinct().join(ranks.select("txn", "rank"), "txn")
    nth = F.row_number().over(Window.partitionBy("seed").orderBy("rank"))
    return touched.withColumn("nth", nth).where(F.col("nth") <= k).select("seed", "txn", "nth")


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (a, b, ...) that touch none of ``nodes`` (one column ``node``)."""
    for side in ("a", "b"):
        edges = edges.join(nodes.select(F.col("node").alias(side)), side, "left_anti")
    return edges


def with_nodes(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, w): edges joined by ``links`` (node, to, w); parallel links sum, loops and weights that
    are not above 0 go."""
    own = links.where((F.col("node") != F.col("to")) & (F.col("w") > 0)).select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"), "w")
    return edges.select("a", "b", "w").unionByName(own).groupBy("a", "b").agg(F.sum("w").alias("w"))


def top_arcs(arcs: DataFrame, k: int, strength: str = "flow") -> DataFrame:
    """(src, dst, strength): the k strongest directed arcs, ties by src, dst."""
    return arcs.select("src", "dst", F.col(strength).alias("strength")).orderBy(F.round("strength", 9).desc(), "src", "dst").limit(k)


def change_weights(*parts: DataFrame) -> DataFrame:
    """(path, added, deleted, binary) over several lists of changes with these columns."""
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.bool_or("binary").alias("binary"))


def merged_branches(branches: DataFrame, base: DataFrame) -> DataFrame:
    """(branch, commits, merged): merged if each of a branch's patches is among the base's.

    ``branches``: (branch, patch), ``base``: (patch); a branch with a null patch only is unknown (null).
    """
    found = branches.join(base.select("patch").distinct().withColumn("hit", F.lit(True)), "patch", "left")
    known = F.col("patch").isNotNull()
    return found.groupBy("branch").agg(F.count_if(known).alias("commits"), F.bool_and(F.when(known, F.coalesce("hit", F.lit(False)))).alias("merged"))


def last_names(renames: DataFrame, steps: int = 40) -> DataFrame:
    """(path, last, hops): where each renamed path has gone in the end.

    ``renames``: (old, new), each ``old`` once.  Pointers double, so a chain of n renames takes log2(n)
    joins; paths on a cycle, which have no end, are left out.
    """
    at = cut(renames.where("old <> new").select(F.col("old").alias("path"), F.col("new").alias("last"), F.lit(1).cast("long").alias("hops")))
    for _ in range(steps):
        onward = at.select(F.col("path").alias("last"), F.col("last").alias("further"), F.col("hops").alias("more"))
        ahead = at.join(onward, "last", "left")
        at = cut(ahead.select("path", F.coalesce("further", "last").alias("last"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("further").isNotNull().alias("moved")))
        if not at.where("moved").head(1):
            break
        at = at.drop("moved")
    ends = at.select("path", "last", "hops")
    return ends.join(renames.where("old <> new").select(F.col("old").alias("last")), "last", "left_anti").select("path", "last", "hops")


def common_directory(rows: DataFrame, group: str, path: str) -> DataFrame:
    """(group, paths, shared): the deepest directory all of a group's paths share, with a slash; null for
    a single path or none.

    What the least and the greatest of the directory lists share, all of them share, so that two
    values a group are enough.
    """
    parts = F.split(F.col(path), "/")
    own = rows.where(F.col(path).isNotNull()).select(group, F.slice(parts, 1, F.size(parts) - 1).alias("d"))
    ends = own.groupBy(group).agg(F.count("*").alias("paths"), F.min("d").alias("low"), F.max("d").alias("high"))
    n = shared_prefix(F.col("low"), F.col("high")).cast("int")
    shared = F.concat(F.array_join(F.slice("low", 1, n), "/"), F.lit("/"))
    return ends.select(group, "paths", F.when((F.col("paths") > 1) & (n > 0), shared).alias("shared"))


def modal_counts(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, n, rank): labels of each group, commonest first, ties by label."""
    counted = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), label)))


def upper_median(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """(group, n, median): the value at index n div 2 in order, from counts of distinct values."""
    counted = rows.select(group, value.alias("v")).where("v is not null").groupBy(group, "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    upto = counted.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    return upto.where("upto > n div 2").groupBy(group).agg(F.max("n").alias("n"), F.min("v").alias("median"))


def alive_half_life(rows: DataFrame, group: str, at: str) -> DataFrame:
    """(group, n, half_life): the upper median age in days before a group's newest row, at least 1."""
    newest = rows.groupBy(group).agg(F.max(at).alias("newest"))
    aged = rows.where(F.col(at).isNotNull()).join(newest, group)
    days = F.floor((F.unix_timestamp("newest") - F.unix_timestamp(at)) / 86400).cast("long")
    return upper_median(aged, group, days).select(group, "n", F.greatest(F.col("median"), F.lit(1)).cast("double").alias("half_life"))


def compound_events(samples: DataFrame, least: int = 2, k: int = 3) -> DataFrame:
    """(series, low, high, observables, magnitude): steps between windows at which several observables jump.

    ``samples``: (series, window, observable, value).  A jump is the change over its base (the plain
    change if that is near 0) per change of log(window); each observable has its k largest.
    """
    w = Window.partitionBy("series", "observable").orderBy("window")
    steps = samples.select("series", "observable", "value", F.col("window").alias("high"), F.lag("window").over(w).alias("low"), F.lag("value").over(w).alias("base"))
    finite = steps.where("low is not null and value is not null and base is not null and low > 0 and high > low and not isnan(value) and not isnan(base) and abs(value) < double('inf') and abs(base) < double('inf')")
    change = F.abs(F.col("value") - F.col("base"))
    jump = F.when(F.abs("base") < 1e-9, change).otherwise(change / F.abs("base")) / F.log(F.col("high") / F.col("low"))
    order = Window.partitionBy("series", "observable").orderBy(F.round("jump", 9).desc(), "high")
    top = finite.withColumn("jump", jump).where("jump > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.groupBy("series", "low", "high").agg(F.count("*").alias("observables"), F.sum("jump").alias("magnitude")).where(F.col("observables") >= least)


def label_strata(rows: DataFrame, series: str, order: list[str], label: str) -> DataFrame:
    """Rows at which a series' label differs from the one before; empty and null labels are skipped."""
    before = F.lag(label).over(Window.partitionBy(series).orderBy(*order))
    return rows.where(F.col(label) != "").withColumn("was", before).where(~F.col(label).eqNullSafe(F.col("was"))).drop("was")


def anomalous_modes(modes: DataFrame, sigma: float = 2.0) -> DataFrame:
    """(grp, mode, value, z): interaction modes whose energy is far above that of their order.

    ``modes``: (grp, mode, value); a mode's order is its number of set bits.  Mode 0 is never returned.
    """
    energy = modes.withColumn("order", F.bit_count("mode")).withColumn("e", F.col("value") * F.col("value"))
    of = energy.groupBy("grp", "order").agg(F.avg("e").alias("mean"), F.stddev_samp("e").alias("deviation"))
    z = (F.col("e") - F.col("mean")) / F.col("deviation")
    return energy.join(of, ["grp", "order"]).where("mode > 0 and deviation >= 1e-15").withColumn("z", z).where(F.col("z") > sigma).select("grp", "mode", "value", "z")
