"""What several operators share: tables, the shared folder, exact hashing of ids."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(name: str = "doc_id") -> Column:
    """An id on its way to pandas: long columns with nulls become floats there and lose digits."""
    return F.col(name).cast("long").cast("string").alias(name)


def longs(ids) -> pd.api.extensions.ExtensionArray:
    """Ids back from :func:`id_text`."""
    return pd.array([None if x is None else int(x) for x in ids], "Int64")


def row_number(docs: DataFrame) -> Column:
    """The row's number in ``docs``, the same at every read of a table.

    Spark cuts small files by the cores it has at that moment, so losing an executor between two
    reads would deal the numbers anew.  The present count is kept for the session if none is set.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:
        conf.set("spark.sql.files.minPartitionNum", str(docs.sparkSession.sparkContext.defaultParallelism))
    return F.monotonically_increasing_id()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent on one machine (tests) a temporary folder is made and set; on a
    cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}/{name}"


#: While a table is written, Spark deletes a query's shuffle files at its end instead of when the
#: driver collects garbage.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows that a Python worker gets at once, for steps that hold several copies of their texts.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, compression: str = "snappy", batch: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    The shuffle files behind it go as soon as the table is complete.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with settings(spark, WHILE_WRITING | ({BATCH: str(batch)} if batch else {})):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(side: DataFrame, name: str) -> str:
    """Write ``side`` (one row for each ``row``) in a folder for each source partition.

    ``row`` comes from :func:`row_number`, which has the partition's number from bit 33 on.  A task
    that reads that partition again finds what belongs to its rows through :class:`Beside`, so a
    table of texts is joined to a table of decisions without a shuffle of the texts.
    """
    spark = side.sparkSession
    path = new_folder(spark, name)
    with settings(spark, WHILE_WRITING):
        side.withColumn("part", F.shiftright("row", 33).cast("int")).repartition("part").sortWithinPartitions("part", "row").write.partitionBy("part").parquet(path)
    return path


class Beside:
    """Reads, within a task, the rows that :func:`beside` wrote for the task's source partition."""

    def __init__(self, path: str):
        self.path, self.part, self.table = path, None, None

    def at(self, rows: np.ndarray) -> tuple:
        """(arrow table, for each of ``rows`` its index in the table or -1)."""
        if len(rows) and self.part != int(rows[0]) >> 33:
            import pyarrow.fs as pafs
            import pyarrow.parquet as pq

            self.part = int(rows[0]) >> 33
            files, root = pafs.FileSystem.from_uri(self.path)
            found = files.get_file_info(pafs.FileSelector(f"{root}/part={self.part}", allow_not_found=True))
            tables = [pq.ParquetFile(f.path, filesystem=files).read() for f in found if f.path.endswith(".parquet")]
            self.table = pa.concat_tables(tables) if tables else None
            self.rows = self.table["row"].to_numpy() if tables else np.zeros(0, np.int64)
        if not len(rows) or not len(self.rows):
            return self.table, np.full(len(rows), -1)
        found = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
        return self.table, np.where(self.rows[found] == rows, found, -1)


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, whose number (see :func:`row_number`) is in ``kept`` (row)."""
    path, name = beside(kept.select("row"), "kept"), fresh(docs, "__row")

    def task(batches):
        side = Beside(path)
        for batch in batches:
            _, at = side.at(batch[name].to_numpy())
            yield batch.drop_columns([name]).filter(pa.array(at >= 0))

    return docs.withColumn(name, row_number(docs)).mapInArrow(task, docs.schema)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``docs`` has no column of."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def remove(df_or_path, spark: SparkSession | None = None) -> None:
    """Delete tables made by :func:`written` once no later step reads them."""
    if isinstance(df_or_path, DataFrame):
        spark, paths = df_or_path.sparkSession, {f.rpartition("/")[0] for f in df_or_path.inputFiles()[:1]}
    else:
        paths = {df_or_path}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        if "/weft-" in path:
            at = hadoop.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
