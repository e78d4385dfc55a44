"""Mixing of evidence, phases and lattices, as column expressions and grouped sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mixed(rows: DataFrame, group: str, p: str, n: str, cap: float = math.log(4)) -> DataFrame:
    """(grp, p, axes): each axis weighs |p - 0.5| * min(ln(1 + n), cap); amplitudes sqrt(p) and
    sqrt(1 - p) are summed with these weights and squared.  Without weight the result is 0.5."""
    w = F.abs(F.col(p) - 0.5) * F.least(F.log1p(n), F.lit(cap))
    s = rows.groupBy(F.col(group).alias("grp")).agg(F.sum(w * F.sqrt(p)).alias("a"), F.sum(w * F.sqrt(1 - F.col(p))).alias("b"), F.count("*").alias("axes"))
    power = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    return s.select("grp", F.when(power > 0, F.col("a") * F.col("a") / power).otherwise(0.5).alias("p"), "axes")


def phase_mix(rows: DataFrame, group: str, strength: str, angle: str) -> DataFrame:
    """(grp, certainty, phase, coherence): the sum of phasors, and the length of the mean unit one."""
    s = rows.groupBy(F.col(group).alias("grp")).agg(
        F.sum(F.col(strength) * F.cos(angle)).alias("x"), F.sum(F.col(strength) * F.sin(angle)).alias("y"), F.sum(F.abs(strength)).alias("t"), F.avg(F.cos(angle)).alias("u"), F.avg(F.sin(angle)).alias("v")
    )
    return s.select("grp", F.when(F.col("t") > 0, F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / F.col("t")).otherwise(0.0).alias("certainty"), F.atan2("y", "x").alias("phase"), F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("coherence"))


def hyperbolic_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of two points of the Poincare disk."""
    gap = (ax - bx) * (ax - bx) + (ay - by) * (ay - by)
    return F.acosh(1 + 2 * gap / ((1 - ax * ax - ay * ay) * (1 - bx * bx - by * by)))


def geometric_blend(a: Column, b: Column, c: Column, eps: float = 1e-12) -> Column:
    return F.pow(F.greatest(a, F.lit(eps)) * F.greatest(b, F.lit(eps)) * F.greatest(c, F.lit(eps)), F.lit(1 / 3))


def reach(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(grp, reach): the participation ratio (sum^2 / sum of squares), scaled to 0 to 1."""
    s = rows.groupBy(F.col(group).alias("grp")).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count("*").alias("n"))
    ratio = (F.col("s") * F.col("s") / F.col("q") - 1) / (F.col("n") - 1)
    return s.select("grp", F.when((F.col("n") > 1) & (F.col("q") > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio))).otherwise(0.0).alias("reach"))


def running_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(grp, n, mean, variance): Spark merges partial moments as a streaming cell would."""
    return rows.groupBy(F.col(group).alias("grp")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def surprise(rows: DataFrame, group: str, category: str) -> DataFrame:
    """(grp, surprise): mean -ln of the prior, the category's share of all rows plus one each."""
    prior = rows.groupBy(category).agg(F.count("*").alias("c"))
    total = prior.agg(F.sum(F.col("c") + 1).alias("t"))
    p = prior.crossJoin(F.broadcast(total)).select(category, (-F.log((F.col("c") + 1) / F.col("t"))).alias("s"))
    return rows.groupBy(F.col(group).alias("grp"), category).agg(F.count("*").alias("n")).join(p, category).groupBy("grp").agg((F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("surprise"))


def subset_sums(cells: DataFrame, bits: int, invert: bool = False) -> DataFrame:
    """(cell, v): sums over the subsets of each cell of a 2^bits lattice (cell, v), or their inverse.

    One pass for each bit, as a cube is built: a cell with the bit set gets its partner's value.
    """
    values = cells.select(F.col("cell").cast("long").alias("cell"), F.col("v").cast("double").alias("v"))
    for k in range(bits):
        up = F.struct(F.col("cell").bitwiseOR(F.lit(1 << k)).alias("cell"), (-F.col("v") if invert else F.col("v")).alias("v"))
        own = F.struct("cell", "v")
        both = F.when(F.col("cell").bitwiseAND(F.lit(1 << k)) == 0, F.array(own, up)).otherwise(F.array(own))
        values = values.select(F.explode(both).alias("x")).groupBy("x.cell").agg(F.sum("x.v").alias("v"))
    return values


def order_spectrum(coefficients: DataFrame, group: str = "grp") -> DataFrame:
    """(grp, bits, energy): squares of Walsh coefficients (grp, k, c) by the bits of k."""
    return coefficients.groupBy(group, F.bit_count("k").alias("bits")).agg(F.sum(F.col("c") * F.col("c")).alias("energy"))


def joint_histogram(rows: DataFrame, a: Column, b: Column, mass: Column) -> DataFrame:
    """(cell, mass): cell = a * 256 + b for two 8-bit addresses."""
    return rows.groupBy((a * 256 + b).alias("cell")).agg(F.sum(mass).alias("mass"))


def parity_signature(rows: DataFrame, group: str, bucket: Column, mass: Column, masks: list[int]) -> DataFrame:
    """(grp, k, v): for each mask the mass with even parity of bucket & mask less that with odd."""
    sign = 1 - 2 * (F.bit_count(F.col("bucket").bitwiseAND(F.col("mask"))) % 2)
    each = rows.select(F.col(group).alias("grp"), bucket.alias("bucket"), mass.alias("m"), F.posexplode(F.array(*map(F.lit, masks))).alias("k", "mask"))
    return each.groupBy("grp", "k").agg(F.sum(F.col("m") * sign).alias("v"))


def budget_prefix(rows: DataFrame, group: str, order: list[Column], cost: Column, budget: float) -> DataFrame:
    """Rows of each group in order until the first that would overflow the budget; the first row
    is always admitted."""
    w = Window.partitionBy(group).orderBy(*order)
    run = rows.withColumns({"cost": cost, "__n": F.row_number().over(w)})
    run = run.withColumn("__run", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("__run") <= budget) | (F.col("__n") == 1)).drop("__n", "__run")


def budget_fill(rows: DataFrame, group: str, key: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """(grp, picked): keys of each group taken in order, those that do not fit skipped.  The fold
    runs over one group's list of candidates."""
    listed = rows.groupBy(F.col(group).alias("grp")).agg(F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(key).alias("key"), cost.cast("long").alias("cost")))).alias("c"))
    kind = dict(rows.dtypes)[key]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("keys"))
    step = lambda a, x: F.when(a["used"] + x["cost"] <= budget, F.struct((a["used"] + x["cost"]).alias("used"), F.array_append(a["keys"], x["key"]).alias("keys"))).otherwise(a)
    return listed.select("grp", F.aggregate("c", start, step, lambda a: a["keys"]).alias("picked"))


def set_overlap(a: Column, b: Column) -> Column:
    """struct(shared, jaccard, label) of two path sets."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    jaccard = F.when(union > 0, shared / union).otherwise(0.0)
    return F.struct(shared.alias("shared"), jaccard.alias("jaccard"), F.when(shared == 0, "apart").when(jaccard >= 0.5, "aligned").otherwise("touching").alias("label"))
