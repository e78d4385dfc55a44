"""Sums over spectra: tables of eigenvalues (grp, value), modes (grp, mode, value, node, u) and projections.

The eigenpairs are given; nothing here solves for them.  All sums are grouped aggregates.  Values at or
below ``ZERO`` belong to the ground space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZERO = 1e-9


def _boltzmann(t: float) -> Column:
    return F.exp(-t * F.col("value"))


def thermal(values: DataFrame, t: float, s: float = 2.0) -> DataFrame:
    """One row for each spectrum: heat trace, excited heat trace, mean and variance of the energy under
    Boltzmann weights, entropy of the modes, zeta and its derivative, log-determinant, first gap,
    relaxation rate and how near that is to the gap."""
    excited, w = F.col("value") > ZERO, _boltzmann(t)
    value = F.col("value")
    sums = values.groupBy("grp").agg(
        F.count("*").alias("modes"),
        F.sum(w).alias("heat_trace"),
        F.sum(F.when(excited, w)).alias("excited_heat_trace"),
        F.sum(w * value).alias("e1"),
        F.sum(w * value * value).alias("e2"),
        F.sum(F.when(excited, w * value)).alias("x1"),
        F.sum(F.when(excited, F.pow(value, -s))).alias("zeta"),
        F.sum(F.when(excited, -F.log(value) * F.pow(value, -s))).alias("zeta_derivative"),
        F.sum(F.when(excited, F.log(value))).alias("log_det"),
        F.min(F.when(excited, value)).alias("gap"),
    )
    mean = F.col("e1") / F.col("heat_trace")
    rate = F.col("x1") / F.col("excited_heat_trace")
    # -sum(p ln p) with p = w / Z is t * mean + ln Z.
    return sums.select(
        "grp", "modes", "heat_trace", "excited_heat_trace", mean.alias("mean_energy"),
        F.greatest(F.lit(0.0), F.col("e2") / F.col("heat_trace") - mean * mean).alias("energy_variance"),
        (t * mean + F.log("heat_trace")).alias("entropy"), "zeta", "zeta_derivative", "log_det", "gap",
        rate.alias("relaxation_rate"), (rate / F.col("gap")).alias("gap_saturation"),
    )


def relaxation_curve(values: DataFrame, t_min: float = 0.1, t_max: float = 50.0, samples: int = 32) -> DataFrame:
    """(grp, sample, t, rate): the Boltzmann average of the non-zero values over a log grid of times."""
    step = (t_max / t_min) ** (1 / (samples - 1))
    grid = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    at = values.where(F.col("value") > ZERO).select("grp", "value", grid).withColumn("t", t_min * F.pow(F.lit(step), "sample"))
    w = F.exp(-F.col("t") * F.col("value"))
    return at.groupBy("grp", "sample").agg(F.max("t").alias("t"), (F.sum(w * F.col("value")) / F.sum(w)).alias("rate"))


def participation(modes: DataFrame) -> DataFrame:
    """(grp, mode, ipr): the inverse participation ratio of each mode, the sum of u^4."""
    return modes.groupBy("grp", "mode").agg(F.sum(F.pow("u", F.lit(4.0))).alias("ipr"))


def heat_signature(modes: DataFrame, times: list[float]) -> DataFrame:
    """(grp, node, profile): the diagonal of the heat kernel at each node, for each of ``times``."""
    sums = [F.sum(F.exp(-t * F.col("value")) * F.col("u") * F.col("u")).alias(f"t{k}") for k, t in enumerate(times)]
    return modes.groupBy("grp", "node").agg(*sums).select("grp", "node", F.array(*(f"t{k}" for k in range(len(times)))).alias("profile"))


def signature_distance(signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, a, b, distance): euclidean distance of two nodes' profiles; ``pairs``: (grp, a, b)."""
    a = signatures.select("grp", F.col("node").alias("a"), F.col("profile").alias("p"))
    b = signatures.select("grp", F.col("node").alias("b"), F.col("profile").alias("q"))
    total = F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(a, ["grp", "a"]).join(b, ["grp", "b"]).select("grp", "a", "b", F.sqrt(total).alias("distance"))


def projected(modes: DataFrame, field: DataFrame) -> DataFrame:
    """(grp, mode, value, c): coefficients of a field (grp, node, x) in the modes."""
    return modes.join(field, ["grp", "node"], "left").groupBy("grp", "mode", "value").agg(F.sum(F.col("u") * F.coalesce("x", F.lit(0.0))).alias("c"))


def field_sums(coefficients: DataFrame, t: float) -> DataFrame:
    """(grp, partition, rayleigh, entropy): of each projected field; entropy is that of its thermal modes."""
    w, c2 = F.exp(-t * F.col("value")) * F.col("c") * F.col("c"), F.col("c") * F.col("c")
    with_z = coefficients.withColumn("w", w).withColumn("z", F.sum("w").over(Window.partitionBy("grp")))
    p = F.col("w") / F.col("z")
    return with_z.groupBy("grp").agg(
        F.max("z").alias("partition"),
        (F.sum(F.col("value") * c2) / F.sum(c2)).alias("rayleigh"),
        F.coalesce(-F.sum(F.when(p > 0, p * F.log(p))), F.lit(0.0)).alias("entropy"),
    )


def divergences(coefficients: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(a, b, l2, jeffreys): of two projected fields over the same modes; ``pairs``: (a, b) groups."""
    z = Window.partitionBy("grp")
    w = coefficients.withColumn("w", F.exp(-t * F.col("value")) * F.col("c") * F.col("c"))
    p = w.withColumn("p", F.col("w") / F.sum("w").over(z)).select("grp", "mode", "value", "c", "p")
    a, b = (p.select(F.col("grp").alias(n), "mode", F.col("value").alias(f"v{n}"), F.col("c").alias(f"c{n}"), F.col("p").alias(f"p{n}")) for n in "ab")
    met = pairs.join(a, "a").join(b, ["b", "mode"])
    gap = F.exp(-2 * t * F.col("va")) * (F.col("ca") - F.col("cb")) * (F.col("ca") - F.col("cb"))
    js = F.when((F.col("pa") > 0) & (F.col("pb") > 0), (F.col("pa") - F.col("pb")) * F.log(F.col("pa") / F.col("pb"))).otherwise(0.0)
    return met.groupBy("a", "b").agg(F.sqrt(F.sum(gap)).alias("l2"), F.sum(js).alias("jeffreys"))


def value_distance(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, distance): mean absolute difference of two spectra matched by rank; null where sizes differ."""
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("value"))).withColumn("size", F.count("*").over(Window.partitionBy("grp")))
    a, b = (ranked.select(F.col("grp").alias(n), "rank", F.col("value").alias(f"v{n}"), F.col("size").alias(f"n{n}")) for n in "ab")
    met = pairs.join(a, "a").join(b, ["b", "rank"]).groupBy("a", "b").agg(F.avg(F.abs(F.col("va") - F.col("vb"))).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return met.select("a", "b", F.when(F.col("na") == F.col("nb"), F.col("d")).alias("distance"))


def harmonic_degree(nodes: DataFrame, weight: str) -> DataFrame:
    """(nodes, harmonic): n / sum(1 / degree) over nodes of positive degree."""
    return nodes.where(F.col(weight) > 0).agg(F.count("*").alias("nodes"), (F.count("*") / F.sum(1 / F.col(weight))).alias("harmonic"))
