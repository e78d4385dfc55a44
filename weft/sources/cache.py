"""A content-addressed table that is refreshed in part: rows whose content stands are kept, others computed.

``data/`` holds computed rows by fingerprint in numbered segments, ``manifest/`` one folder a version with the
(key, fingerprint) pairs that are live.  A version counts once its manifest is complete, so a refresh that
is lost midway leaves the version before it; its segment is found by the next one and used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ContentCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Complete folders of ``kind``, ascending."""
        if not self._files.exists(self._at(kind)):
            return []
        found = [s.getPath().getName() for s in self._files.listStatus(self._at(kind))]
        return sorted(int(n) for n in found if n.isdigit() and self._files.exists(self._at(f"{kind}/{n}/_SUCCESS")))

    def _data(self) -> DataFrame | None:
        found = self._numbers("data")
        return self.spark.read.parquet(*(f"{self.path}/data/{n}" for n in found)) if found else None

    def manifest(self) -> DataFrame | None:
        found = self._numbers("manifest")
        return self.spark.read.parquet(f"{self.path}/manifest/{found[-1]}") if found else None

    def rows(self) -> DataFrame:
        """The live rows: key and what was computed of its content."""
        live, data = self.manifest(), self._data()
        if live is None or data is None:
            raise ValueError("nothing was published yet")
        return live.join(data.dropDuplicates(["fingerprint"]), "fingerprint").drop("fingerprint")

    def refresh(self, table: DataFrame, key: str, content: list[str], compute) -> int:
        """Publish the rows of ``table``; returns how many contents had to be computed.

        ``compute`` takes (fingerprint, *content), one row for each content that no segment has, and returns
        fingerprint and the computed columns.  Keys that ``table`` lacks are gone from the new version; equal
        contents are computed once, whatever their keys, and also if an earlier version had them.
        """
        print_ = F.sha2(F.to_json(F.struct(*content)), 256)
        own = table.select(F.col(key).alias("key"), *content).withColumn("fingerprint", print_)
        data = self._data()
        new = own.select("fingerprint", *content)
        if data is not None:
            new = new.join(data.select("fingerprint"), "fingerprint", "left_anti")
        new = new.dropDuplicates(["fingerprint"])
        number = max([0, *self._numbers("data"), *self._numbers("manifest")]) + 1
        compute(new).write.mode("overwrite").parquet(f"{self.path}/data/{number}")
        computed = self.spark.read.parquet(f"{self.path}/data/{number}").count()
        own.select("key", "fingerprint").write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        return computed

    def prune(self) -> None:
        """Rewrite what is live as one segment, and drop the others and earlier manifests."""
        live, data = self.manifest(), self._data()
        if live is None or data is None:
            return
        segments, versions = self._numbers("data"), self._numbers("manifest")
        number = max(*segments, *versions) + 1
        data.join(live.select("fingerprint").distinct(), "fingerprint", "left_semi").dropDuplicates(["fingerprint"]).write.parquet(f"{self.path}/data/{number}")
        for kind, n in [("data", n) for n in segments] + [("manifest", n) for n in versions[:-1]]:
            self._files.delete(self._at(f"{kind}/{n}"), True)
