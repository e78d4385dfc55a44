"""Sums over given fields (key, node, value) and eigenvectors: cosine, overlap, coherence, projections.

A node that a field lacks has value 0.  All are joins on keys and nodes with grouped sums; pairs of fields
are never formed but those asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spectrum import ZERO


def _joined(fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, x, y): values of both fields at the nodes that either has."""
    asked = pairs.select("a", "b").distinct()
    side = lambda key, mine, other: asked.join(fields.select(F.col("key").alias(key), "node", F.col("value").alias(mine)), key).withColumn(other, F.lit(0.0)).select("a", "b", "node", "x", "y")
    both = side("a", "x", "y").unionAll(side("b", "y", "x"))
    return both.groupBy("a", "b", "node").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def compare_fields(fields: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine, overlap) of pairs of fields; overlap is the sum of sqrt(xy) over nodes where both are positive.

    The cosine with an empty field is 0; a pair of which neither side has a value gives no row.
    """
    root = F.when((F.col("x") > 0) & (F.col("y") > 0), F.sqrt(F.col("x") * F.col("y"))).otherwise(0.0)
    square = lambda c: F.sum(F.col(c) * F.col(c)).alias(c + c)
    sums = _joined(fields, pairs).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), square("x"), square("y"), F.sum(root).alias("overlap"))
    cosine = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / (F.sqrt("xx") * F.sqrt("yy"))).otherwise(0.0)
    return sums.select("a", "b", cosine.alias("cosine"), "overlap")


def coherence(fields: DataFrame) -> DataFrame:
    """(grp, fields, coherence) of (grp, key, node, value): the mean cosine over all pairs of a group's fields.

    The squared length of the sum of unit fields holds all pairs at once, so none is formed.  Fields without
    mass do not count; fewer than two give 1.
    """
    whole = fields.groupBy("grp", "key", "node").agg(F.sum("value").alias("value"))
    norms = whole.groupBy("grp", "key").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    unit = whole.join(norms.where("norm > 0"), ["grp", "key"]).select("grp", "node", (F.col("value") / F.col("norm")).alias("u"))
    total = unit.groupBy("grp", "node").agg(F.sum("u").alias("s")).groupBy("grp").agg(F.sum(F.col("s") * F.col("s")).alias("s"))
    n = F.col("fields")
    counts = norms.groupBy("grp").agg(F.count_if(F.col("norm") > 0).alias("fields"))
    mean = F.when(n >= 2, (F.col("s") - n) / (n * (n - 1))).otherwise(1.0)
    return counts.join(total, "grp", "left").select("grp", "fields", mean.alias("coherence"))


def expected_tokens(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """(key, token, expected): the mass that a field gives each token, by the token's share of its node.

    ``tokens``: (node, token, n).  Nodes without positive mass or tokens give nothing.
    """
    total = F.sum("n").over(Window.partitionBy("node"))
    share = tokens.select("node", "token", "n").withColumn("total", total).where("total > 0")
    return fields.where("value > 0").join(share, "node").groupBy("key", "token").agg(F.sum(F.col("value") * F.col("n") / F.col("total")).alias("expected"))


def restrict(members: DataFrame, values: DataFrame) -> DataFrame:
    """(coarse, value): weighted sums of fine values; members are (fine, coarse, w), missing values 0."""
    return members.join(values.select("fine", "value"), "fine", "left").groupBy("coarse").agg(F.coalesce(F.sum(F.col("w") * F.col("value")), F.lit(0.0)).alias("value"))


def prolongate(members: DataFrame, values: DataFrame) -> DataFrame:
    """(fine, value): the adjoint of ``restrict``; every fine node gets its coarse values times its weights."""
    return members.join(values.select("coarse", "value"), "coarse", "left").groupBy("fine").agg(F.coalesce(F.sum(F.col("w") * F.col("value")), F.lit(0.0)).alias("value"))


def effective_resistance(modes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, x, y, resistance) from (grp, mode, value, node, u); the ground space is left out, equal nodes give 0."""
    asked = pairs.select("grp", "x", "y").distinct()
    live = modes.where(F.col("value") > ZERO)
    one = asked.join(live.select("grp", "mode", "value", F.col("node").alias("x"), F.col("u").alias("ux")), ["grp", "x"])
    both = one.join(live.select("grp", "mode", F.col("node").alias("y"), F.col("u").alias("uy")), ["grp", "mode", "y"])
    d = F.col("ux") - F.col("uy")
    return both.groupBy("grp", "x", "y").agg(F.sum(d * d / F.col("value")).alias("resistance"))


def set_projections(modes: DataFrame, sets: DataFrame) -> DataFrame:
    """(grp, set_id, mode, p): sums of each eigenvector over the distinct nodes of each set (set_id, node)."""
    return modes.join(sets.select("set_id", "node").distinct(), "node").groupBy("grp", "set_id", "mode").agg(F.sum("u").alias("p"))


def spectral_spread(projections: DataFrame) -> DataFrame:
    return projections.groupBy("grp", "set_id").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("spread"))


def set_distance(projections: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, a, b, distance) between the projections of pairs of sets."""
    one = projections.select("grp", "mode", F.col("set_id").alias("a"), F.col("p").alias("x")).join(pairs.select("a", "b").distinct(), "a")
    both = one.join(projections.select("grp", "mode", F.col("set_id").alias("b"), F.col("p").alias("y")), ["grp", "mode", "b"])
    d = F.col("x") - F.col("y")
    return both.groupBy("grp", "a", "b").agg(F.sqrt(F.sum(d * d)).alias("distance"))


def turning(points: DataFrame) -> DataFrame:
    """(series, step, cosine, angle) of (series, step, spectrum): how a trajectory turns at each inner step.

    Tangents are differences of consecutive spectra, cut to the shortest of the three.  Without a move on
    either side both values are null.
    """
    w = Window.partitionBy("series").orderBy("step")
    three = points.select("series", "step", F.lag("spectrum").over(w).alias("a"), F.col("spectrum").alias("b"), F.lead("spectrum").over(w).alias("c")).where("a is not null and c is not null and b is not null")
    k = F.least(F.size("a"), F.size("b"), F.size("c"))
    cut = lambda x: F.slice(x, 1, k)
    before, after = F.zip_with(cut("b"), cut("a"), lambda x, y: x - y), F.zip_with(cut("c"), cut("b"), lambda x, y: x - y)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    sums = three.select("series", "step", before.alias("p"), after.alias("q")).select("series", "step", dot("p", "q").alias("pq"), dot("p", "p").alias("pp"), dot("q", "q").alias("qq"))
    cosine = F.when((F.col("pp") > 1e-300) & (F.col("qq") > 1e-300), F.col("pq") / (F.sqrt("pp") * F.sqrt("qq")))
    return sums.select("series", "step", cosine.alias("cosine"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("angle"))


def consensus(asked: DataFrame, samples: DataFrame, n: int) -> DataFrame:
    """(query, items, confidence): the share of asked items (query, item) that at least half of n samples
    (query, sample, item) name too."""
    seen = samples.groupBy("query", "item").agg(F.count_distinct("sample").alias("hits"))
    rows = asked.select("query", "item").distinct().join(seen, ["query", "item"], "left")
    agreed = F.count_if(F.coalesce("hits", F.lit(0)) >= -(-n // 2))
    return rows.groupBy("query").agg(F.count("*").alias("items"), (agreed / F.count("*")).alias("confidence"))
