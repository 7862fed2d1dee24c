"""The inference cache: what a model said, by a key of configuration, case, image and schema. Scores are never cached."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "key string, config_hash string, case_id string, payload string, created_at string"


def cache_key(config_hash: Column, case_id: Column, image_hash: Column, schema_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", config_hash, case_id, image_hash, schema_hash), 256)


def split(cases: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases that the cache answers, with the payload, and those that it doesn't."""
    return cases.join(cached.select("key", "payload"), "key"), cases.join(cached.select("key"), "key", "left_anti")


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each key."""
    order = Window.partitionBy("key").orderBy(F.desc("created_at"), F.desc("payload"))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


class Cache:
    """A folder of Parquet parts; puts only add, reads take the last of each key, so a run that breaks off leaves a sound cache.

    Where the folder can't be used the cache turns itself off, and runs go on without it.
    """

    def __init__(self, spark: SparkSession, folder: str, enabled: bool = True):
        self.spark, self.folder, self.enabled, self.reason = spark, folder.rstrip("/"), enabled, ""
        if enabled:
            try:
                if not self._exists():
                    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(self.folder)
                self.rows().limit(1).count()
            except Exception as e:  # noqa: BLE001  whatever the file system says
                self.enabled, self.reason = False, str(e).splitlines()[0]

    def _exists(self) -> bool:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(hadoop).exists(path)

    def rows(self) -> DataFrame:
        if not self.enabled:
            return self.spark.createDataFrame([], SCHEMA)
        return latest(self.spark.read.schema(SCHEMA).parquet(self.folder))

    def put(self, rows: DataFrame) -> None:
        """Adds answers; failures aren't to be put, so that they are tried again."""
        if self.enabled:
            rows.select("key", "config_hash", "case_id", "payload", "created_at").write.mode("append").parquet(self.folder)

    def clear(self, config_hash: str | None = None) -> int:
        """Forgets all, or one configuration's answers; how many keys went."""
        if not self.enabled:
            return 0
        rows = self.rows()
        gone = rows if config_hash is None else rows.where(F.col("config_hash") == config_hash)
        n, aside = gone.count(), f"{self.folder}-{uuid.uuid4().hex}"
        kept = rows.limit(0) if config_hash is None else rows.where(F.col("config_hash") != config_hash)
        kept.write.parquet(aside)
        self.spark.read.schema(SCHEMA).parquet(aside).write.mode("overwrite").parquet(self.folder)
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(aside)
        path.getFileSystem(hadoop).delete(path, True)
        return n

    def stats(self) -> dict:
        return {"enabled": self.enabled, "folder": self.folder, "entries": self.rows().count() if self.enabled else 0, "reason": self.reason}

    def close(self) -> None:
        """Nothing is held open."""
