"""Files as rows: contents up to a size, and texts without the binary ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contents import looks_binary

#: Largest content that is read, in bytes.
CAP = 20 * 1024 * 1024


def blobs(spark: SparkSession, path: str, wanted: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """(path, state, length, content) of the files below a folder, paths relative to it.

    state: loaded, too_large (content null; it is not read, the filter on the length reaches the scan) or,
    for a path of ``wanted`` (path) without a row, failed: there is no such file, or it is empty, as
    Spark's file sources list no file of zero bytes.  With ``wanted`` other files have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").removeprefix("file://") + "/"
    name = F.substr("path", F.locate(root, F.col("path")) + len(root)).alias("path")
    small = files.where(F.col("length") <= cap).select(name, F.lit("loaded").alias("state"), "length", "content")
    large = files.where(F.col("length") > cap).select(name, F.lit("too_large").alias("state"), "length", F.lit(None).cast("binary").alias("content"))
    both = small.unionByName(large)
    if wanted is None:
        return both
    return wanted.select("path").distinct().join(both, "path", "left").withColumn("state", F.coalesce("state", F.lit("failed")))


def texts(loaded: DataFrame) -> DataFrame:
    """(path, text, lines) of the loaded files that are no binaries; malformed UTF-8 becomes U+FFFD."""
    kept = loaded.where((F.col("state") == "loaded") & ~looks_binary(F.col("content")))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return kept.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), text.alias("text")).withColumn("lines", F.size(F.split("text", "\n")))


def harvest(loaded: DataFrame) -> DataFrame:
    """One row (tracked, texts, binaries, failed, too_large)."""
    binary = F.coalesce(looks_binary(F.col("content")), F.lit(False))
    state = F.col("state")
    return loaded.agg(
        F.count("*").alias("tracked"), F.count_if((state == "loaded") & ~binary).alias("texts"), F.count_if((state == "loaded") & binary).alias("binaries"), F.count_if(state == "failed").alias("failed"), F.count_if(state == "too_large").alias("too_large")
    )
