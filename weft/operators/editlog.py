"""A mergeable edit log over a graph, ordered by (lamport, peer).

Edits: (lamport, peer, kind, path_a, path_b, weight); kind is add, remove, set_edge or noop.
Any order and any repetition of the same edits gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(*logs: DataFrame) -> DataFrame:
    """One log of all edits; an edit is told by its clock."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.dropDuplicates(["lamport", "peer"])


def version_vector(log: DataFrame) -> DataFrame:
    """(peer, lamport): the newest edit seen of each peer."""
    return log.groupBy("peer").agg(F.max("lamport").alias("lamport"))


def merged_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise maximum."""
    return a.unionByName(b).groupBy("peer").agg(F.max("lamport").alias("lamport"))


def dominates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dominates): whether a has seen everything that b has."""
    return b.join(a.withColumnRenamed("lamport", "seen"), "peer", "left").agg(F.coalesce(F.every(F.coalesce(F.col("seen"), F.lit(-1)) >= F.col("lamport")), F.lit(True)).alias("dominates"))


def delta(log: DataFrame, seen: DataFrame) -> DataFrame:
    """The edits that a peer with the version vector ``seen`` lacks."""
    return log.join(seen.withColumnRenamed("lamport", "known"), "peer", "left").where(F.col("lamport") > F.coalesce("known", F.lit(-1))).select(*log.columns)


def removed_paths(log: DataFrame) -> DataFrame:
    """(path, clock): the first removal of a path wins for good, a later re-add does not bring it back."""
    return log.where("kind = 'remove'").groupBy(F.col("path_a").alias("path")).agg(F.min(F.struct("lamport", "peer")).alias("clock"))


def live_nodes(log: DataFrame) -> DataFrame:
    """(path) of nodes added, or set by an edge, and never removed; an endpoint of an edge counts
    only if the edge came before the other end's removal."""
    gone = removed_paths(log)
    added = log.where("kind = 'add'").select(F.col("path_a").alias("path"))
    ends = log.where("kind = 'set_edge'").select("path_a", "path_b", F.struct("lamport", "peer").alias("at"))
    ends = ends.select(F.col("path_a").alias("path"), F.col("path_b").alias("other"), "at").union(ends.select("path_b", "path_a", "at"))
    early = ends.join(gone.select(F.col("path").alias("other"), "clock"), "other", "left").where("clock is null or at < clock").select("path")
    return added.union(early).distinct().join(gone.select("path"), "path", "left_anti")


def live_edges(log: DataFrame) -> DataFrame:
    """(a, b, weight): last writer wins for each pair; edges of removed paths are gone."""
    gone = removed_paths(log).select("path")
    sets = log.where("kind = 'set_edge'").groupBy(F.least("path_a", "path_b").alias("a"), F.greatest("path_a", "path_b").alias("b")).agg(F.max_by("weight", F.struct("lamport", "peer")).alias("weight"))
    return sets.join(gone.select(F.col("path").alias("a")), "a", "left_anti").join(gone.select(F.col("path").alias("b")), "b", "left_anti").select("a", "b", "weight")


def compacted(log: DataFrame) -> DataFrame:
    """A shorter log with the same final state: removals, and the last write of each live pair."""
    first = log.where("kind = 'remove'").groupBy("path_a").agg(F.min_by(F.struct(*log.columns), F.struct("lamport", "peer")).alias("x")).select("x.*")
    pair = (F.least("path_a", "path_b"), F.greatest("path_a", "path_b"))
    live = live_edges(log).select("a", "b")
    last = log.where("kind = 'set_edge'").groupBy(pair[0].alias("a"), pair[1].alias("b")).agg(F.max_by(F.struct(*log.columns), F.struct("lamport", "peer")).alias("x")).join(live, ["a", "b"], "left_semi").select("x.*")
    linked = live.select(F.col("a").alias("path_a")).union(live.select("b"))
    alone = live_nodes(log).select(F.col("path").alias("path_a")).join(linked, "path_a", "left_anti")
    adds = log.where("kind in ('add', 'set_edge')")
    lone = adds.select(F.col("path_a").alias("p"), F.struct(*log.columns).alias("x")).union(adds.where("kind = 'set_edge'").select(F.col("path_b").alias("p"), F.struct(*log.columns).alias("x")))
    kept = lone.join(alone.withColumnRenamed("path_a", "p"), "p").groupBy("p").agg(F.min_by("x", F.struct("x.lamport", "x.peer")).alias("x"))
    # A lone node keeps one edit with its clock, turned into an add of that node.
    as_add = kept.select(*(F.col("p").alias(c) if c == "path_a" else F.lit("add").alias(c) if c == "kind" else F.lit(None).cast(log.schema[c].dataType).alias(c) if c in ("path_b", "weight") else F.col(f"x.{c}").alias(c) for c in log.columns))
    return first.unionByName(last).unionByName(as_add)


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, left_value, right_value, change): rows of two states that differ."""
    joined = a.select(*keys, F.col(value).alias("left_value")).join(b.select(*keys, F.col(value).alias("right_value")), keys, "full_outer")
    change = F.when(F.col("left_value").isNull(), "added").when(F.col("right_value").isNull(), "removed").when(F.col("left_value") != F.col("right_value"), "changed")
    return joined.withColumn("change", change).where("change is not null")
