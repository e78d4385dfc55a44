"""Conflict blocks in files of lines: (key, line_no, text).

``<<<<<<<`` opens a block, ``|||||||`` its base, ``=======`` the other side, ``>>>>>>>`` ends it.  An opening
line drops an unfinished block before it.  Lines are worked on per file; no file's text is put together
but for its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def conflict_lines(lines: DataFrame) -> DataFrame:
    """(key, line_no, text, block, side): side is ours, base, theirs, marker or clean; block counts
    from 0 and is null outside blocks.  A block that never ends gives no rows but its clean surroundings
    stay: the lines of an unfinished block have side ``open`` and no block.
    """
    file = Window.partitionBy("key").orderBy("line_no")
    starts = lambda mark: F.col("text").startswith(mark)
    tried = lines.select("key", "line_no", "text").withColumn("try", F.count_if(starts("<<<<<<<")).over(file))
    one = Window.partitionBy("key", "try")
    marks = tried.withColumn("mid", F.min(F.when(starts("=======") & (F.col("try") > 0), F.col("line_no"))).over(one))
    marks = marks.withColumn("base", F.min(F.when(starts("|||||||") & (F.col("line_no") < F.coalesce("mid", F.lit(1 << 62))), F.col("line_no"))).over(one))
    marks = marks.withColumn("end", F.min(F.when(starts(">>>>>>>") & (F.col("line_no") > F.col("mid")), F.col("line_no"))).over(one))
    n, first = F.col("line_no"), starts("<<<<<<<")
    side = (
        F.when(F.col("try") == 0, "clean")
        .when(F.col("end").isNull(), "open")
        .when(n > F.col("end"), "clean")
        .when(first | n.eqNullSafe(F.col("base")) | (n == F.col("mid")) | (n == F.col("end")), "marker")
        .when(n > F.col("mid"), "theirs")
        .when(n > F.col("base"), "base")
        .otherwise("ours")
    )
    out = marks.withColumn("side", side)
    block = F.count_if((F.col("side") == "marker") & first).over(file) - 1
    return out.select("key", "line_no", "text", F.when(F.col("side").isin("clean", "open"), None).otherwise(block).alias("block"), "side")


def conflict_blocks(tagged: DataFrame) -> DataFrame:
    """(key, block, ours, base, theirs): texts of each block; base is null if it has no line."""

    def text(side: str):
        own = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("line_no", "text"))))
        return F.array_join(F.transform(own, lambda x: x["text"]), "\n")

    texts = tagged.where("block is not null").groupBy("key", "block").agg(text("ours").alias("ours"), text("base").alias("base"), F.count_if(F.col("side") == "base").alias("n"), text("theirs").alias("theirs"))
    return texts.select("key", "block", "ours", F.when(F.col("n") > 0, F.col("base")).alias("base"), "theirs")


def resolved(tagged: DataFrame, choices: DataFrame) -> DataFrame:
    """(key, line_no, text): the lines that stay once blocks are resolved.

    ``choices``: (key, block, take), take being ours, theirs, base or both, one row a block.  A block
    without a choice keeps all its lines, markers included.
    """
    chosen = tagged.join(choices.select("key", "block", "take"), ["key", "block"], "left")
    stays = F.col("take").isNull() | (F.col("side") == F.col("take")) | ((F.col("take") == "both") & F.col("side").isin("ours", "theirs"))
    return chosen.where(stays).select("key", "line_no", "text")
