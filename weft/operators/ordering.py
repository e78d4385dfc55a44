"""Numbers in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def numbered(df: DataFrame, order: list[Column], name: str = "n", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, .. in ``order``; rows are dealt by ranges and counted by partition."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = laid.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))  # one row a partition
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))
    own = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("__part", part).join(starts, "__part").withColumn(name, F.col("__before") + own).drop("__part", "__before", "__at")
