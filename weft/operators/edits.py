"""Line diffs by anchors, edit units of diff lines, and moves of lines that are alike.

Lines: (doc, line, text).  A diff's rows: (doc, pos, kind, old_no, new_no, text), kind del, add or
context, in the order of ``pos``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchors(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, i, j): lines that stand once on either side, without those that would cross another one.

    A pair stays if no other pair before it lies behind it on the other side, and none behind it before.
    """
    once = lambda d, name: d.groupBy("doc", "text").agg(F.min("line").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    met = once(old, "i").join(once(new, "j"), ["doc", "text"]).select("doc", "i", "j")
    by = Window.partitionBy("doc").orderBy("i")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    ends = met.withColumns({"top": F.max("j").over(before), "low": F.min("j").over(after)})
    return ends.where("(top is null or top < j) and (low is null or low > j)").select("doc", "i", "j")


def line_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """A diff of every doc's ``old`` and ``new`` lines.

    Anchors cut both texts into gaps.  In a gap, equal lines at the same distance behind its anchor, and
    before its next one, are context as far as they reach without a break; of the rest the old lines are
    deleted and the new ones added.
    """
    side = lambda d, k: d.select("doc", F.lit(k).alias("side"), F.col("line").cast("long").alias("at"), "text")
    # Every window's keys begin with the doc: lines are shuffled once, and only sorted from there on.
    rows = side(old, 0).union(side(new, 1)).repartition("doc")
    of_old, of_new = F.col("side") == 0, F.col("side") == 1
    met = Window.partitionBy("doc", "text")
    once = (F.count_if(of_old).over(met) == 1) & (F.count_if(of_new).over(met) == 1) & F.col("text").isNotNull()
    rows = rows.withColumn("partner", F.when(once, F.when(of_old, F.min(F.when(of_new, F.col("at"))).over(met)).otherwise(F.min(F.when(of_old, F.col("at"))).over(met))))
    by = Window.partitionBy("doc", "side").orderBy("at")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    top, low = F.max("partner").over(before), F.min("partner").over(after)
    rows = rows.withColumn("anchor", F.when((top.isNull() | (top < F.col("partner"))) & (low.isNull() | (low > F.col("partner"))), F.col("partner"))).drop("partner")
    rows = rows.withColumn("gap", F.count("anchor").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("anchor")
    own, both = Window.partitionBy("doc", "side", "gap"), Window.partitionBy("doc", "gap")
    rows = rows.withColumn("ahead", F.row_number().over(own.orderBy("at"))).withColumn("behind", F.count("*").over(own) - F.col("ahead"))
    for key in ("ahead", "behind"):
        beside = Window.partitionBy("doc", "gap", key)
        same = (F.count("text").over(beside) == 2) & (F.min("text").over(beside) == F.max("text").over(beside))
        rows = rows.withColumns({f"by_{key}": F.max(F.when(of_new, F.col("at"))).over(beside), f"broken_{key}": F.when(of_old & ~same, F.col(key))})
    least = F.least(F.count_if(of_old).over(both), F.count_if(of_new).over(both))
    run = lambda key, first: F.coalesce(F.min(f"broken_{key}").over(both) - first, least)
    rows = rows.withColumns({"least": least, "head": F.least(run("ahead", 1), least), "tail": run("behind", 0)}).withColumn("tail", F.least("tail", F.col("least") - F.col("head")))
    in_head, in_tail = F.col("ahead") <= F.col("head"), (F.col("ahead") > F.col("head")) & (F.col("behind") < F.col("tail"))
    kept = rows.where(of_old | ~(in_head | in_tail))
    placed = kept.select(
        "doc", "gap", "ahead", "text",
        F.when(of_new, "add").when(in_head | in_tail, "context").otherwise("del").alias("kind"),
        F.when(of_new, 2).when(in_head, 0).when(in_tail, 3).otherwise(1).alias("zone"),
        F.when(of_old, F.col("at")).alias("old_no"),
        F.when(of_new, F.col("at")).when(in_head, F.col("by_ahead")).when(in_tail, F.col("by_behind")).alias("new_no"),
    )
    pos = F.row_number().over(Window.partitionBy("doc").orderBy("gap", "zone", "ahead"))
    return placed.withColumn("pos", pos).select("doc", "pos", "kind", "old_no", "new_no", "text")


def hunks_of(diff: DataFrame) -> DataFrame:
    """``diff`` with ``hunk``: runs of rows that are no context, numbered in each doc; null for context."""
    order = Window.partitionBy("doc").orderBy("pos")
    starts = (F.col("kind") != "context") & (F.coalesce(F.lag("kind").over(order), F.lit("context")) == "context")
    return diff.withColumn("hunk", F.when(F.col("kind") != "context", F.sum(starts.cast("int")).over(order)))


def edit_units(lines: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """One unit for each line, but one for a deletion right before an addition of its hunk.

    ``lines``: (keys, order, kind, hunk, text).  unit: its number in ``keys``; kind: replace, delete, insert or
    the line's own; old_text and new_text.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    beside = lambda f: F.struct(f("kind").over(w).alias("kind"), f("hunk").over(w).alias("hunk"), f("text").over(w).alias("text"))
    rows = lines.withColumns({"__next": beside(F.lead), "__last": beside(F.lag)})
    replaced = (F.col("kind") == "del") & (F.col("__next.kind") == "add") & F.col("__next.hunk").eqNullSafe(F.col("hunk"))
    taken = (F.col("kind") == "add") & (F.col("__last.kind") == "del") & F.col("__last.hunk").eqNullSafe(F.col("hunk"))
    kind = F.when(replaced, "replace").when(F.col("kind") == "del", "delete").when(F.col("kind") == "add", "insert").otherwise(F.col("kind"))
    units = rows.where(~F.coalesce(taken, F.lit(False))).withColumn("unit_kind", kind)
    return units.select(
        *keys, F.row_number().over(w).alias("unit"), F.col("unit_kind").alias("kind"), "hunk",
        F.when(~F.col("unit_kind").isin("insert"), F.col("text")).alias("old_text"),
        F.when(F.col("unit_kind") == "replace", F.col("__next.text")).when(F.col("unit_kind").isin("insert", "context"), F.col("text")).alias("new_text"),
    )


def replacement_pairs(lines: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """(keys, deleted, added): places of deletions right before an addition of their hunk."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = lines.withColumns({"__kind": F.lead("kind").over(w), "__hunk": F.lead("hunk").over(w), "added": F.lead(order).over(w)})
    return rows.where((F.col("kind") == "del") & (F.col("__kind") == "add") & F.col("__hunk").eqNullSafe(F.col("hunk"))).select(*keys, F.col(order).alias("deleted"), "added")


#: Most bits in which the fingerprints of a moved line differ, and pieces of which one is then whole.
NEAR, PIECES = 8, 9


def fuzzy_moves(units: DataFrame, keys: list[str], fingerprint: str = "hash") -> DataFrame:
    """(keys, from_unit, to_unit, distance): deletions and insertions that are one moved line.

    ``units``: (keys, unit, kind, hash); of two within ``NEAR`` bits one of ``PIECES`` runs of bits is equal, so an
    equi-join on the runs finds all of them, each in its first equal run alone.  In order, each deletion takes its nearest insertion that is
    not taken, ties to the first, never the unit beside it: one pass over the sorted pairs.
    """
    low = [64 * k // PIECES for k in range(PIECES + 1)]
    piece = lambda h, k: F.shiftright(h, low[k]).bitwiseAND(F.lit((1 << low[k + 1] - low[k]) - 1))
    runs = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), piece(F.col("h"), k).alias("bits")) for k in range(PIECES))))
    of = lambda kind, name: units.where((F.col("kind") == kind) & (F.col(fingerprint) != 0)).select(*keys, F.col("unit").alias(name), F.col(fingerprint).alias("h"))
    d = of("delete", "d").withColumn("run", runs).select(*keys, "d", F.col("h").alias("hd"), "run")
    i = of("insert", "i").withColumn("run", runs).select(*keys, "i", F.col("h").alias("hi"), "run")
    apart = F.col("hd").bitwiseXOR(F.col("hi"))
    first = reduce(Column.__and__, ((F.col("run.k") <= k) | (piece(apart, k) != 0) for k in range(PIECES - 1)))
    met = d.join(i, [*keys, "run"]).withColumn("distance", F.bit_count(apart)).where((F.col("distance") <= NEAR) & (F.abs(F.col("d") - F.col("i")) > 1) & first)
    types = dict(met.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + f", from_unit {types['d']}, to_unit {types['i']}, distance int"
    offers = met.select(*keys, "d", "distance", "i")
    return offers.repartition(*keys).sortWithinPartitions(*keys, "d", "distance", "i").mapInPandas(_taken, schema)


def _taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of offers (keys, d, distance, i) in order, each d's first i that no earlier d has; a group's own i are held, no offers."""
    key, last, gone = None, None, set()
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False, name=None):
            group, (d, distance, i) = row[:-3], row[-3:]
            if group != key:
                key, last, gone = group, None, set()
            if d != last and i not in gone:
                last = d
                gone.add(i)
                out.append((*group, d, i, distance))
        if out:
            yield pd.DataFrame(out)
