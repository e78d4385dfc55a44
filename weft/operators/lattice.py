"""Moments over the cells of a bit lattice that merge, and transforms over its rows.

A lattice is a table (grp, cell, v) or of moments (grp, cell, n, mean, m2).  A transform takes one step a
bit: every row goes to the two cells that differ in that bit, so a lattice of 2^bits cells costs bits
times its rows, however it is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Values that a cell needs before its mean counts, and what it is until then.
WARM, COLD = 8, 0.5


def observed(rows: DataFrame, group: str, address: Column, value: Column, bits: int = 8) -> DataFrame:
    """(grp, cell, n, mean, m2): moments of the values at each address, the lowest ``bits`` bits of it."""
    cell = address.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    return rows.select(F.col(group).alias("grp"), cell.alias("cell"), value.cast("double").alias("v")).where("v is not null").groupBy("grp", "cell").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), (F.coalesce(F.var_pop("v"), F.lit(0.0)) * F.count("*")).alias("m2")
    )


def merged(*lattices: DataFrame) -> DataFrame:
    """Moments of several lattices as one: counts add, means weigh, squares take the means' spread in."""
    rows = lattices[0]
    for other in lattices[1:]:
        rows = rows.unionByName(other)
    s = rows.groupBy("grp", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("t"), F.sum("m2").alias("m2"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    mean = F.col("t") / F.col("n")
    return s.select("grp", "cell", "n", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("m2") + F.col("q") - F.col("t") * mean).alias("m2"))


def anomalies(rows: DataFrame, lattice: DataFrame, sigma: float = 1.5) -> DataFrame:
    """``rows`` (grp, cell, v, ...) with z, how far v is below its cell's mean in deviations, and odd:
    z above ``sigma``, or a cell that is not warm."""
    known = lattice.select("grp", "cell", F.col("n").alias("__n"), "mean", F.sqrt(F.col("m2") / (F.col("n") - 1)).alias("__s"))
    warm = F.coalesce(F.col("__n") >= WARM, F.lit(False))
    z = F.when(warm & (F.col("__s") > 0), (F.col("mean") - F.col("v")) / F.col("__s")).otherwise(0.0)
    return rows.join(known, ["grp", "cell"], "left").withColumns({"z": z, "odd": ~warm | (z > sigma)}).drop("__n", "__s", "mean")


def means(lattice: DataFrame, bits: int = 8) -> DataFrame:
    """(grp, cell, v) of all 2^bits cells of each group: the mean where warm, else ``COLD``."""
    cells = lattice.select("grp").distinct().select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << bits) - 1).cast("long"))).alias("cell"))
    v = F.when(F.col("n") >= WARM, F.col("mean")).otherwise(COLD)
    return cells.join(lattice, ["grp", "cell"], "left").select("grp", "cell", v.alias("v"))


def walsh_rows(cells: DataFrame, bits: int, inverse: bool = False, first: int = 0) -> DataFrame:
    """(grp, cell, v): Walsh-Hadamard coefficients; bits ``first`` to ``bits`` - 1 only, so that a product
    lattice is transformed factor by factor."""
    out = cells.select("grp", "cell", F.col("v").cast("double").alias("v"))
    for bit in range(first, bits):
        mask = F.lit(1 << bit).cast("long")
        low, high = F.col("cell").bitwiseAND(F.bitwise_not(mask)), F.col("cell").bitwiseOR(mask)
        sign = F.when(F.col("cell").bitwiseAND(mask) == 0, 1.0).otherwise(-1.0)
        two = F.array(F.struct("grp", low.alias("cell"), F.col("v").alias("v")), F.struct("grp", high.alias("cell"), (sign * F.col("v")).alias("v")))
        out = out.select(F.inline(two)).groupBy("grp", "cell").agg(F.sum("v").alias("v"))
        if bit % 4 == 3:
            out = cut(out)
    return out.withColumn("v", F.col("v") / float(1 << (bits - first))) if inverse else out


def heat(cells: DataFrame, bits: int, t: float) -> DataFrame:
    """(grp, cell, v): heat on the hypercube after ``t``; each coefficient fades by exp(-2 t / bits) a bit."""
    damped = walsh_rows(cells, bits).withColumn("v", F.col("v") * F.exp(F.bit_count("cell") * (-2.0 * t / bits)))
    return walsh_rows(damped, bits, inverse=True)


def dominant(spectrum: DataFrame, most_bits: int = 4, k: int = 32) -> DataFrame:
    """(grp, cell, v, rank): the ``k`` strongest coefficients of 1 to ``most_bits`` bits, ties to the lesser cell."""
    from pyspark.sql import Window

    order = Window.partitionBy("grp").orderBy(F.round(F.abs("v"), 9).desc(), "cell")
    return spectrum.where(F.bit_count("cell").between(1, most_bits)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def order_shares(spectrum: DataFrame) -> DataFrame:
    """(grp, bits, share): the share of the energy at each number of bits."""
    from pyspark.sql import Window

    e = spectrum.groupBy("grp", F.bit_count("cell").alias("bits")).agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    total = F.sum("e").over(Window.partitionBy("grp"))
    return e.select("grp", "bits", F.when(total > 0, F.col("e") / total).otherwise(0.0).alias("share"))
