"""Sinks: Parquet, JSON lines and partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def parquet(df: DataFrame, path: str, by: list[str] | None = None, rows_per_file: int = 5_000_000) -> None:
    """Parquet files of bounded size; with ``by`` one folder for each value."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table whose joins and groupings on ``key`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def append_stream(df: DataFrame, path: str, checkpoint: str):
    """A stream's rows as Parquet, each batch once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
