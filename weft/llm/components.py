"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node points its larger neighbours to the least node it sees."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node points itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node of its component.

    ``links``: (a, b) of one orderable type; self-links and repeats do no harm, nulls are ignored.
    Each round is written to the shared folder; a round's figures (rows and a hash sum) tell when
    nothing changes.  An empty table gives an empty table.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = written(_small_star(_large_star(edges)), "edges")
        remove(edges)
        edges = now
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
