"""Co-occurrence of items that share a transaction.

Pairs are made by an equi-join on the transaction, so the cost is the sum of squared transaction
sizes.  A large transaction is cut into blocks of items, and each pair of blocks is a join key of its
own, so that no task has to pair all of it.  Large transactions fade by weight; none is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Ranges of a score whose counts are one small table.
BINS = 4096
#: Rows of a partition where pairs are made.
ROWS = 250_000
#: Items of a set that are looked up one by one.
SMALL = 64
#: Width of a bin of ranks, in gaps.
WIDE = 4


def transaction_items(rows: DataFrame, txn: str, item: str, mass: Column | None = None) -> DataFrame:
    """(txn, item, mass): one row for each item of a transaction; mass is at least 1."""
    own = rows.where(F.col(txn).isNotNull() & F.col(item).isNotNull()).select(F.col(txn).alias("txn"), F.col(item).alias("item"), (mass if mass is not None else F.lit(1.0)).alias("m"))
    return dealt(own, partitions(rows), "txn").groupBy("txn", "item").agg(F.greatest(F.lit(1.0), F.sum("m").cast("double")).alias("mass"))


def partitions(rows: DataFrame) -> int | None:
    """In how many partitions the rows of a table are to be dealt: none, if each core has one at most.

    What Spark deals itself may be read in larger pieces, by the bytes of its shuffles, which are far
    fewer than those of the rows that a task sorts or sums.
    """
    n = -(-rows.count() // ROWS)
    return n if n > rows.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    return df if n is None else df.repartition(n, *keys)


def pairs(items: DataFrame, block: int = 1000, parts: int | None = None) -> DataFrame:
    """(txn, a, b, mass_a, mass_b) with a < b, of transactions with two items or more; ``parts``: see :func:`partitions`."""
    items = dealt(items, parts, "txn")
    sized = items.withColumn("n", F.count("*").over(Window.partitionBy("txn"))).where("n >= 2")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = sized.withColumn("last", blocks - 1).withColumn("at", F.pmod(F.hash("item"), blocks))
    left = own.select("txn", F.col("item").alias("x"), F.col("mass").alias("mx"), F.col("at").alias("i"), F.explode(F.sequence("at", "last")).alias("j"))
    right = own.select("txn", F.col("item").alias("y"), F.col("mass").alias("my"), F.col("at").alias("j"), F.explode(F.sequence(F.lit(0), "at")).alias("i"))
    left, right = (dealt(side, parts, "txn", "i", "j") for side in (left, right))
    met, swap = left.join(right, ["txn", "i", "j"]).where("x < y or (i < j and x <> y)"), F.col("x") > F.col("y")
    return met.select("txn", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(swap, F.col("my")).otherwise(F.col("mx")).alias("mass_a"), F.when(swap, F.col("mx")).otherwise(F.col("my")).alias("mass_b"))


def jaccard_edges(items: DataFrame) -> DataFrame:
    """(a, b, together, score): unweighted Jaccard of the transactions of a and b.

    Partitions follow the rows, so that what a task sums and sorts does not grow with the table.
    """
    items = cut(items)
    n = partitions(items)
    together = dealt(pairs(items, parts=n).select("a", "b"), n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("together"))
    degree = dealt(items.groupBy("item").agg(F.count("*").alias("n")), n, "item")
    of_a = dealt(together, n, "a").join(degree.select(F.col("item").alias("a"), F.col("n").alias("na")), "a")
    of_b = dealt(of_a, n, "b").join(degree.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    return of_b.select("a", "b", "together", (F.col("together") / (F.col("na") + F.col("nb") - F.col("together"))).alias("score"))


def decayed_edges(items: DataFrame, ranks: DataFrame, half_life: float, knee: float = 60.0) -> DataFrame:
    """(a, b, score): Jaccard with weight 2^(-age / half_life) * meaning * min(1, knee / items).

    ``ranks``: (txn, age, meaning).  An item's total is the weighted sum of its masses, a pair's the
    weighted sum of the geometric means of the two masses.
    """
    size = items.groupBy("txn").agg(F.count("*").alias("size"))
    weight = size.join(ranks, "txn").select("txn", (F.pow(F.lit(2.0), -F.col("age") / half_life) * F.col("meaning") * F.least(F.lit(1.0), F.lit(knee) / F.col("size"))).alias("w"))
    total = items.join(weight, "txn").groupBy("item").agg(F.sum(F.col("w") * F.col("mass")).alias("t"))
    shared = pairs(items).join(weight, "txn").groupBy("a", "b").agg(F.sum(F.col("w") * F.sqrt(F.col("mass_a") * F.col("mass_b"))).alias("c"))
    joined = shared.join(total.select(F.col("item").alias("a"), F.col("t").alias("ta")), "a").join(total.select(F.col("item").alias("b"), F.col("t").alias("tb")), "b")
    union = F.col("ta") + F.col("tb") - F.col("c")
    return joined.where(union > 0).select("a", "b", (F.col("c") / union).alias("score"))


def lagged_edges(items: DataFrame, ranks: DataFrame, half_life: float, lags: int = 3, knee: float = 60.0) -> DataFrame:
    """(a, b, lag_score): pairs of items in transactions 1 to ``lags`` ranks apart, each of the two
    weighted by min(1, knee / items)."""
    size = items.groupBy("txn").agg(F.count("*").alias("size"))
    soft = F.least(F.lit(1.0), F.lit(knee) / F.col("size"))
    force = soft * F.sqrt(F.pow(F.lit(2.0), -F.col("rank") / half_life)) * F.sqrt("mass")  # all that an item brings to a pair
    rows = items.join(size, "txn").join(ranks.select("txn", "rank"), "txn").select("item", "rank", force.alias("v"))
    later = rows.select(F.col("item").alias("i2"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "rank", "v").select("i2", (F.col("v") / (1 + F.col("lag"))).alias("v2"), (F.col("rank") - F.col("lag")).alias("rank"))
    met = rows.join(later, "rank").where("item <> i2")
    score = F.col("v") * F.col("v2")
    return met.groupBy(F.least("item", "i2").alias("a"), F.greatest("item", "i2").alias("b")).agg(F.sum(score).alias("lag_score"))


def both_ways(edges: DataFrame, weight: str = "score") -> DataFrame:
    """(src, dst, w): each undirected edge from both sides."""
    way = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.col(weight).alias("w"))
    return edges.select(F.inline(F.array(way("a", "b"), way("b", "a"))))  # one pass over what makes the edges


def centrality(edges: DataFrame, weight: str = "score") -> DataFrame:
    """(item, centrality, max_neighbour, degree) from incident weights."""
    return both_ways(edges, weight).groupBy(F.col("src").alias("item")).agg(F.sum("w").alias("centrality"), F.max("w").alias("max_neighbour"), F.count("*").alias("degree"))


def top_neighbours(edges: DataFrame, k: int, least: float = 0.0, weight: str = "score") -> DataFrame:
    """(src, dst, w, rank): the k strongest neighbours of each item, ties by neighbour."""
    order = Window.partitionBy("src").orderBy(F.desc("rounded"), "dst")
    ways = both_ways(edges, weight).where(F.col("w") >= least).withColumn("rounded", F.round("w", 9))
    return ways.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rounded")


def symmetrised(edges: DataFrame, k: int, weight: str = "score") -> DataFrame:
    """(a, b, w): edges among the top k of either end."""
    top = top_neighbours(edges, k, weight=weight)
    return top.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"))


def blast_radius(edges: DataFrame, seeds: DataFrame, k: int = 20, weight: str = "score") -> DataFrame:
    """(item, score, via): the k items most coupled to any seed, seeds left out.

    ``seeds``: one column ``seed``.  Ties go to the lesser item; via is the seed of the best edge.
    """
    near = both_ways(edges, weight).join(seeds.select(F.col("seed").alias("src")).distinct(), "src").join(seeds.select(F.col("seed").alias("dst")), "dst", "left_anti")
    best = near.groupBy(F.col("dst").alias("item")).agg(F.max("w").alias("score"), F.min_by("src", F.struct(-F.round("w", 9), "src")).alias("via"))
    return best.orderBy(F.round("score", 9).desc(), "item").limit(k)


def coherence(edges: DataFrame, sets: DataFrame, weight: str = "score") -> DataFrame:
    """(set_id, size, coherence): mean pairwise score of each set, absent pairs 0, one item 1.

    ``sets``: (set_id, item).  Sets of up to ``SMALL`` items look up an edge for each of their pairs, larger ones
    go through the edges of their items.
    """
    members = sets.select("set_id", "item").distinct()
    size = members.groupBy("set_id").agg(F.count("*").alias("size"))
    sized = members.withColumn("size", F.count("*").over(Window.partitionBy("set_id")))
    own = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col(weight).alias("s"))
    small = pairs(sized.where(F.col("size") <= SMALL).select(F.col("set_id").alias("txn"), "item", F.lit(1.0).alias("mass"))).select(F.col("txn").alias("set_id"), "a", "b")
    large = sized.where(F.col("size") > SMALL).select("set_id", "item")
    of_small = small.join(own, ["a", "b"]).select("set_id", "s")
    of_large = own.join(large.withColumnRenamed("item", "a"), "a").join(large.withColumnRenamed("item", "b"), ["set_id", "b"]).select("set_id", "s")
    inner = of_small.union(of_large).groupBy("set_id").agg(F.sum("s").alias("s"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    return size.join(inner, "set_id", "left").select("set_id", "size", F.when(F.col("size") < 2, 1.0).otherwise(F.coalesce("s", F.lit(0.0)) / possible).alias("coherence"))


#: Neighbours of an item in one list, about.
LISTED = 4096


def _stretches(ways: DataFrame, turns: DataFrame, confidence: float, low: float) -> DataFrame:
    """(src, next, dst): edges of at least ``low`` from src that with next's reach twice as much.  ``turns``: (src, next).

    Lists of neighbours meet, cut in parts by dst if an item has over ``LISTED``; without a positive ``low`` every
    edge of src counts.
    """
    strong = F.col("w") * confidence >= low
    if low <= 0:
        return turns.join(ways.where(strong), "src").select("src", "next", "dst")
    widest = ways.groupBy("src").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64("dst"), F.lit(-(-widest // LISTED) or 1)).cast("int")
    listed = ways.groupBy("src", part.alias("part")).agg(F.collect_list(F.struct("dst", "w")).alias("x"))
    sent = F.filter("x", lambda y: y["w"] * confidence >= low)
    mine = listed.select("src", "part", sent["dst"].alias("d"), sent["w"].alias("v")).where(F.size("d") > 0)
    whole = listed.select(F.col("src").alias("next"), "part", F.map_from_entries("x").alias("of"))
    both = turns.join(mine, "src").join(whole, ["next", "part"], "left")
    found = both.select("src", "next", "of", F.inline(F.arrays_zip("d", "v")))
    return found.where((F.col("v") + F.coalesce(F.element_at("of", F.col("d")), F.lit(0.0))) * confidence >= 2 * low).select("src", "next", F.col("d").alias("dst"))


def missing_peers(edges: DataFrame, sets: DataFrame, confidence: float = 1.0, least: float = 0.05, k: int = 5, weight: str = "score") -> DataFrame:
    """(set_id, item, score, anchor): items outside a set with the highest mean score to it; ``edges`` has a pair once.

    Go round a set in any order: if the mean reaches ``least``, it does from some item on over every stretch
    that begins there.  So a candidate has an edge of that weight from an item and from that one and the next
    together twice as much, and only such candidates are scored: each two neighbours in a set meet by their
    lists (see :func:`_stretches`), which are no rows.  Sets of one item need the best ``k`` of it.  Sets of
    up to ``SMALL`` items look up an edge for each of their items, larger ones go through the candidate's own
    neighbours.
    """
    members = sets.select("set_id", "item").distinct()
    edges = cut(edges.select("a", "b", F.col(weight).alias("s")))
    ways = both_ways(edges, "s").where("src <> dst")
    low = least - 1e-9
    round_ = Window.partitionBy("set_id").orderBy("item")
    sized = members.withColumn("size", F.count("*").over(Window.partitionBy("set_id"))).where("item is not null")
    of_set = cut(sized.withColumn("next", F.coalesce(F.lead("item").over(round_), F.first("item").over(round_))).withColumnRenamed("item", "src"))
    order = Window.partitionBy("src").orderBy(F.round(F.col("w") * confidence, 9).desc(), "dst")
    best = ways.where(F.col("w") * confidence >= low).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    of_one = of_set.where("size = 1").join(best, "src").select("set_id", "size", "dst")
    turns = of_set.where("size > 1").select("set_id", "size", "src", "next")
    met = _stretches(ways, turns.select("src", "next").distinct(), confidence, low)
    of_more = turns.join(met, ["src", "next"]).select("set_id", "size", "dst")
    outside = cut(of_one.union(of_more).distinct().join(members.withColumnRenamed("item", "dst"), ["set_id", "dst"], "left_anti"))
    of_set = of_set.select("set_id", "src")
    own = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("s").alias("w"))
    by_item = outside.where(F.col("size") <= SMALL).join(of_set, "set_id").withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(own, ["a", "b"]).select("set_id", "size", "dst", "src", "w")
    by_neighbour = outside.where(F.col("size") > SMALL).join(ways, "dst").join(of_set, ["set_id", "src"])
    near = by_item.unionByName(by_neighbour.select(*by_item.columns))
    scored = near.groupBy("set_id", "size", "dst").agg(F.sum("w").alias("s"), F.min_by("src", F.struct(-F.round("w", 9), "src")).alias("anchor"))
    score = F.round(F.col("s") / F.col("size") * confidence, 9)
    scored = scored.select("set_id", F.col("dst").alias("item"), score.alias("score"), "anchor").where(F.col("score") >= least)
    order = Window.partitionBy("set_id").orderBy(F.col("score").desc(), "item")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def ghosts(live: DataFrame, shadow: DataFrame, least: float = 0.05, k: int = 50, weight: str = "score") -> DataFrame:
    """(a, b, score): shadow edges without a live one, the strongest k."""
    return shadow.join(live.select("a", "b"), ["a", "b"], "left_anti").where(F.col(weight) >= least).orderBy(F.round(weight, 9).desc(), "a", "b").limit(k).select("a", "b", F.col(weight).alias("score"))


def deja_vu(live: DataFrame, shadow: DataFrame) -> DataFrame:
    """(pairs, ghosts, ratio): the share of shadow pairs that no live edge has."""
    seen = shadow.select("a", "b").join(live.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left")
    return seen.agg(F.count("*").alias("pairs"), F.count_if(F.col("hit").isNull()).alias("ghosts")).withColumn("ratio", F.when(F.col("pairs") > 0, F.col("ghosts") / F.col("pairs")).otherwise(0.0))


def blended(live: DataFrame, shadow: DataFrame, discount: float = 0.5) -> DataFrame:
    """(a, b, score): the greater of the live score and the discounted shadow score."""
    both = live.select("a", "b", "score").unionByName(shadow.select("a", "b", (F.col("score") * discount).alias("score")))
    return both.groupBy("a", "b").agg(F.max("score").alias("score"))


def keystones(edges: DataFrame, touches: DataFrame, share: float = 0.1, least: int = 3) -> DataFrame:
    """(item, touches, pull, keystone, is_keystone): pull / ln(1 + touches), the top share flagged.

    No task orders all items: a histogram of ``BINS`` ranges of the score tells how many items stand
    above each range, and a rank within its range completes it.
    """
    pull = both_ways(edges).groupBy(F.col("src").alias("item")).agg(F.sum("w").alias("pull"))
    scored = cut(touches.join(pull, "item").select("item", "touches", "pull", (F.col("pull") / F.log1p("touches")).alias("keystone")))
    ends = scored.agg(F.min(F.round("keystone", 9)).alias("low"), F.max(F.round("keystone", 9)).alias("high"))
    place = F.floor((F.round("keystone", 9) - F.col("low")) / (F.col("high") - F.col("low")) * BINS)
    binned = scored.crossJoin(F.broadcast(ends)).withColumn("bin", F.when(F.col("high") > F.col("low"), place).otherwise(F.lit(0))).drop("low", "high")
    hist = binned.groupBy("bin").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = hist.select("bin", above.alias("above"), F.greatest(F.lit(least), F.ceil(F.round(F.sum("n").over(Window.partitionBy(F.lit(0))) * share, 6))).alias("most"))
    rank = F.col("above") + F.row_number().over(Window.partitionBy("bin").orderBy(F.round("keystone", 9).desc(), "item"))
    return binned.join(F.broadcast(hist), "bin").select("item", "touches", "pull", "keystone", (rank <= F.col("most")).alias("is_keystone"))


def architecture(edges: DataFrame, groups: DataFrame, volatility: DataFrame, sample: int = 8) -> DataFrame:
    """(grp, n_items, inner_edges, mean_inner, mean_volatility, sample): groups of two or more.

    ``groups``: (item, grp); ``volatility``: (item, volatility).
    """
    inside = edges.join(groups.select(F.col("item").alias("a"), "grp"), "a").join(groups.select(F.col("item").alias("b"), F.col("grp").alias("grp_b")), "b").where("grp = grp_b").groupBy("grp").agg(F.count("*").alias("inner_edges"), F.avg("score").alias("mean_inner"))
    ranked = groups.withColumn("nth", F.row_number().over(Window.partitionBy("grp").orderBy("item"))).where(F.col("nth") <= sample)
    samples = ranked.groupBy("grp").agg(F.array_sort(F.collect_list("item")).alias("sample"))  # ``sample`` items each
    sampled = groups.join(volatility, "item", "left").groupBy("grp").agg(F.count("*").alias("n_items"), F.avg("volatility").alias("mean_volatility")).join(samples, "grp")
    return sampled.where("n_items >= 2").join(inside, "grp", "left").select("grp", "n_items", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"), F.coalesce("mean_inner", F.lit(0.0)).alias("mean_inner"), "mean_volatility", "sample")


def hyperedges(items: DataFrame, low: int = 3, high: int = 8) -> DataFrame:
    """(txn, members): transactions of ``low`` to ``high`` items."""
    return items.groupBy("txn").agg(F.array_sort(F.collect_set("item")).alias("members")).where(F.size("members").between(low, high))


def hyperedge_lift(items: DataFrame, focus: DataFrame, least: int = 2, low: int = 3, high: int = 8) -> DataFrame:
    """(item, hits, best): items of hyperedges that share ``least`` or more with the focus set."""
    edges = hyperedges(items, low, high).select("txn", F.size("members").alias("n"), F.explode("members").alias("item"))
    met = edges.join(focus.select(F.col("seed").alias("item")), "item", "left_semi").groupBy("txn").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    rest = edges.join(met, "txn").join(focus.select(F.col("seed").alias("item")), "item", "left_anti")
    return rest.groupBy("item").agg(F.count("*").alias("hits"), F.max(F.col("overlap") / F.col("n")).alias("best"))


def coupling_confidence(transactions: int, items: int) -> float:
    """min(1, transactions / max(50, 0.4 * items))."""
    return min(1.0, transactions / max(50.0, 0.4 * items))


def common(pairs_: DataFrame, items: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, c, n_a, n_b): items that given transactions a and b share, and how many each has; pairs that share none go.

    ``items``: (txn, item), and columns ``more`` of the transaction, which come along as x_a and x_b.  Two of up to ``SMALL`` items carry them; of others the lesser one looks up its items in
    the greater.
    """
    size = items.groupBy("txn").agg(F.count("*").alias("n"), F.collect_list("item").alias("of"), *(F.first(c).alias(c) for c in more)).withColumn("of", F.when(F.col("n") <= SMALL, F.col("of")))
    side = lambda x: size.select(F.col("txn").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "of", *more)))
    own = ["n_a", "n_b", *(f"{c}_{x}" for c in more for x in "ab")]
    sized = pairs_.join(side("a"), "a").join(side("b"), "b")
    small = (F.col("n_a") <= SMALL) & (F.col("n_b") <= SMALL)
    few = sized.where(small).select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("c"), *own)
    less = F.col("n_a") <= F.col("n_b")
    rest = sized.where(~small).select("a", "b", *own, F.when(less, F.col("a")).otherwise(F.col("b")).alias("txn"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("other"))
    met = rest.join(items, "txn").join(items.select(F.col("txn").alias("other"), "item"), ["other", "item"])
    return few.where("c > 0").union(met.groupBy("a", "b").agg(F.count("*").alias("c"), *(F.first(c).alias(c) for c in own)))


def first_neighbours(items: DataFrame, k: int, order: str = "txn") -> DataFrame:
    """(a, b): each transaction a with the ``k`` first others, by ``order`` and key, that share an item with it.

    An item's ``k`` + 1 first transactions have them: no item pairs all of its own.
    """
    first = items.withColumn("at", F.row_number().over(Window.partitionBy("item").orderBy(order, "txn"))).where(F.col("at") <= k + 1)
    by_key = order == "txn"  # then a key is all there is to know
    entry = F.col("txn") if by_key else F.struct(F.col(order).alias("o"), F.col("txn").alias("b"))
    listed = first.groupBy("item").agg(F.collect_list(entry).alias("first"))
    other = F.col("x") if by_key else F.col("x.b")
    met = items.select("txn", "item").join(listed, "item").select("txn", F.explode("first").alias("x")).where(other != F.col("txn")).groupBy("txn").agg(F.slice(F.sort_array(F.collect_set("x")), 1, k).alias("x"))
    return met.select(F.col("txn").alias("a"), F.explode("x").alias("x")).select("a", other.alias("b"))


def transaction_graph(items: DataFrame, ranks: DataFrame, k: int = 16, rate: float = 0.1) -> DataFrame:
    """(src, dst, w): transactions linked by Jaccard of their items times exp(-rate * rank gap).

    Links are ordered at nine digits, so of those whose gap alone makes them nothing there, the ones with
    the least keys are the best: a transaction is compared with those near in rank and the first by key.
    Without a rate all transactions of an item are paired, in blocks.
    """
    own = cut(items.select("txn", "item").join(ranks.select("txn", "rank"), "txn"))
    if rate > 0:
        gap = math.ceil(math.log(2e9) / rate) + 1
        wide = WIDE * gap
        bin_ = F.floor(F.col("rank") / wide)
        ahead = F.when(F.pmod("rank", F.lit(wide)) >= wide - gap, F.array(bin_, bin_ + 1)).otherwise(F.array(bin_))  # near the end of a bin also the next one
        here = own.select("item", F.col("txn").alias("a"), F.col("rank").alias("r"), F.explode(ahead).alias("bin"))
        there = own.select("item", F.col("txn").alias("b"), F.col("rank").alias("q"), bin_.alias("bin"))
        later = (F.struct("r", "a") < F.struct("q", "b")) & (F.col("q") - F.col("r") <= gap)
        near = here.join(there, ["item", "bin"]).where(later).select("a", "b")
        found = near.union(first_neighbours(own, 2 * k))
    else:
        found = pairs(own.select(F.col("item").alias("txn"), F.col("txn").alias("item"), F.lit(1.0).alias("mass"))).select("a", "b")
    found = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())  # what found them is deleted
    rows = common(found, own, ("rank",))
    w = F.col("c") / (F.col("n_a") + F.col("n_b") - F.col("c")) * F.exp(-rate * F.abs(F.col("rank_a") - F.col("rank_b")))
    return top_neighbours(rows.select("a", "b", w.alias("score")), k).select("src", "dst", "w")
