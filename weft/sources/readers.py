"""Readers of commit logs, status listings and JSON lines as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a log record, one line each: git log --format=%H%n%h%n%P%n%D%n%s%n%an%n%ae%n%aI
LOG_FIELDS = ("commit_hash", "short_hash", "parents", "refs", "subject", "author_name", "author_email", "authored_at")

TELEMETRY = "id string, scope string, command string, ok boolean, error_code string, duration_ms long, created_at timestamp"


def words(column: Column, separator: str) -> Column:
    return F.filter(F.split(column, separator), lambda x: x != "")


def commit_log(spark: SparkSession, path: str, separator: str = "\x1e") -> DataFrame:
    """Commits of a log file whose records of eight lines end with ``separator``.

    The separator is the reader's line separator, so a file is split between records and read in
    parallel.  Malformed records are dropped.
    """
    lines = spark.read.text(path, lineSep=separator).select(F.split(F.regexp_replace("value", r"^\n+|\n+$", ""), "\n").alias("f")).where(F.size("f") == len(LOG_FIELDS))
    rows = lines.select(*(F.get("f", F.lit(k)).alias(name) for k, name in enumerate(LOG_FIELDS)))
    return rows.withColumns({"parents": words(F.col("parents"), " "), "refs": words(F.col("refs"), ", "), "authored_at": F.try_to_timestamp("authored_at")}).withColumn("is_merge", F.size("parents") > 1)


def numstat(spark: SparkSession, path: str, separator: str = "\x1e") -> DataFrame:
    """(commit_hash, path, additions, deletions, binary) of a log with --numstat.

    A record is the hash on its first line and a line for each file; renames name the new path.
    """
    records = spark.read.text(path, lineSep=separator).select(F.split(F.trim("value"), "\n").alias("f")).where(F.length(F.get("f", F.lit(0))) > 0)
    rows = records.select(F.trim(F.get("f", F.lit(0))).alias("commit_hash"), F.explode(F.slice("f", 2, 100_000_000)).alias("line"))
    p = r"^(\d+|-)\t(\d+|-)\t(.+)$"
    rows = rows.where(F.col("line").rlike(p))
    return rows.select(
        "commit_hash",
        renamed_path(F.regexp_extract("line", p, 3)).alias("path"),
        F.coalesce(F.regexp_extract("line", p, 1).try_cast("int"), F.lit(0)).alias("additions"),
        F.coalesce(F.regexp_extract("line", p, 2).try_cast("int"), F.lit(0)).alias("deletions"),
        F.col("line").startswith("-").alias("binary"),
    )


def renamed_path(path: Column) -> Column:
    """The new path of "a/{x => y}/b" or "x => y"."""
    braces = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(braces, r"^.* => ", ""), "//+", "/")


def status(spark: SparkSession, path: str) -> DataFrame:
    """(code, path) of a porcelain v2 status listing; headers are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^[12u?!] "))
    kind = F.substring("value", 1, 1)
    plain = r"^(?:1 (?:\S+ ){7}|2 (?:\S+ ){8}|u (?:\S+ ){9}|[?!] )([^\t]*)"
    return lines.select(F.when(kind.isin("1", "2", "u"), F.regexp_extract("value", r"^\S (\S+)", 1)).otherwise(kind).alias("code"), F.regexp_extract("value", plain, 1).alias("path"))


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; missing fields are null, malformed lines are dropped."""
    df = spark.read.schema(TELEMETRY + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return df.where("_bad is null").drop("_bad")


def telemetry_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TELEMETRY).json(path)


def ancestors(spark: SparkSession, parents: DataFrame, starts: DataFrame) -> DataFrame:
    """(commit_hash): what is reachable from ``starts`` over (child, parent), starts included."""
    parents.createOrReplaceTempView("weft_parents")
    starts.createOrReplaceTempView("weft_starts")
    return spark.sql(
        """WITH RECURSIVE reach(commit_hash) AS (
             SELECT commit_hash FROM weft_starts
             UNION ALL SELECT p.parent FROM weft_parents p JOIN reach r ON p.child = r.commit_hash)
           SELECT DISTINCT commit_hash FROM reach"""
    )
