"""Operator 12, exact dedup: a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table of one row for each distinct text, in buckets by digest and sorted
within each.  A batch of new data is hashed once, reduced to one row for each digest on the map side
already, and its unknown digests are found by a sort-merge anti-join: the index is read bucket by
bucket as it lies, only the batch's digests are shuffled.  They are appended to the index.  A
second table beside it, in the same buckets, holds how often each batch saw a digest.

Texts are equal if they are identical after each run of ASCII white space is one space; equality is
told by SHA-256.  Of equal texts the one that the index has stays, and within a batch the row with
the smallest doc_id; a batch that is added a second time under its name gives the same decisions
and changes nothing, so a batch whose driver was lost is simply added again.

Defined results: a null text counts as empty.  A null doc_id is larger than any other; repeated rows
with one doc_id are told apart by their place in the table, and one of them stays.  An empty table
gives an empty result.  Columns other than doc_id and text are not read.  A group that holds a third
of all rows is one row for each task after the map-side aggregation; its decision reaches its rows by
a broadcast of at most ``HOT`` groups, those above a ``HOT``-th of the batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, row_number, written

SPACES = r"[\x20\x09-\x0D]+"
#: Groups above 1/HOT of a batch's rows are broadcast; there are at most HOT of them.
HOT = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest) of every row of ``docs``, written once: texts are read and hashed once."""
    return written(docs.select(row_number(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "digests")


class DigestIndex:
    """The index at ``path``; an existing one is opened, with the number of buckets it was made with."""

    SCHEMA = {"known": "digest binary, keep_id bigint, keep_row bigint, batch string", "seen": "digest binary, batch string, n bigint"}

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), f"weft_{uuid.uuid4().hex}"
        self.buckets = self._buckets_at(buckets)
        for kind, columns in self.SCHEMA.items():
            spark.sql(f"CREATE TABLE {self.name}_{kind} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{kind}'")

    def _buckets_at(self, asked: int | None) -> int:
        """The number of buckets is kept beside the tables, as Parquet files do not tell it."""
        jvm, at = self.spark.sparkContext._jvm, f"{self.path}/buckets"
        where = jvm.org.apache.hadoop.fs.Path(at)
        if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.read.parquet(at).first()[0]
        asked = asked or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.range(asked, asked + 1).coalesce(1).write.parquet(at)
        return asked

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def _append(self, rows: DataFrame, kind: str) -> None:
        # One task for each bucket, so each append leaves one sorted file in a bucket.
        rows.repartition(self.buckets, "digest").write.insertInto(f"{self.name}_{kind}")
        self.spark.catalog.refreshTable(f"{self.name}_{kind}")

    def unknown(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` whose digest the index does not hold."""
        return groups.join(self.table("known").select("digest").hint("merge"), "digest", "left_anti")

    def add(self, hashed: DataFrame, batch: str) -> None:
        """Append what ``hashed`` (see :func:`digests`) has and the index has not."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        groups = written(hashed.groupBy("digest").agg(first, F.count("*").alias("n")), "groups")
        self._append(self.unknown(groups).select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.lit(batch).alias("batch")), "known")
        again = self.table("seen").where(F.col("batch") == batch).select("digest").hint("merge")
        self._append(groups.join(again, "digest", "left_anti").select("digest", F.lit(batch).alias("batch"), "n"), "seen")

    def groups(self) -> DataFrame:
        """(digest, keep_id, keep_row, batch, n) of every text; both tables meet bucket by bucket."""
        sizes = self.table("seen").groupBy("digest").agg(F.sum("n").alias("n"))
        return self.table("known").hint("merge").join(sizes, "digest")

    def decide(self, hashed: DataFrame, batch: str | None = None) -> DataFrame:
        """One row for each row of ``hashed``: which row stays, of how many seen in all batches.

        ``hashed`` may have a column ``batch`` in place of the argument.
        """
        hashed = hashed if batch is None else hashed.withColumn("batch", F.lit(batch))
        groups = self.groups().select("digest", "keep_id", "keep_row", F.col("batch").alias("keep_batch"), "n")
        counts = hashed.groupBy("digest").agg(F.count("*").alias("here"))
        hot = F.broadcast(written(groups.join(counts.where(F.col("here") > hashed.count() / HOT).select("digest"), "digest"), "hot"))
        rare = hashed.join(hot.select("digest"), "digest", "left_anti").hint("merge").join(groups, "digest")
        return hashed.join(hot, "digest").unionByName(rare).select(
            "doc_id", "keep_id", F.col("n").alias("group_size"),
            ((F.col("row") == F.col("keep_row")) & (F.col("batch") == F.col("keep_batch"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def close(self) -> None:
        """Take the tables' names out of the session; the files stay."""
        for kind in self.SCHEMA:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")


def deduplicated(docs: DataFrame, batches: int = 3, path: str | None = None) -> DataFrame:
    """Decisions on ``docs``, added to an index in ``batches`` of ascending doc_id.

    As an index keeps what came first, ascending batches keep the smallest doc_id of all; where the
    batches are cut makes no difference to the result.
    """
    spark = docs.sparkSession
    index, hashed = DigestIndex(spark, path or new_folder(spark, "index")), digests(docs)
    cuts = hashed.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    number = sum((F.coalesce(F.col("doc_id") > c, F.lit(True)).cast("int") for c in cuts), F.lit(0))
    hashed = hashed.withColumn("batch", number.cast("string"))
    for k in range(len(cuts) + 1):
        index.add(hashed.where(F.col("batch") == str(k)), str(k))
    return index.decide(hashed)


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d
"""
