"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a session with a local master (tests) gets a temporary folder; on a cluster
    that would be a different folder on every machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sentrel-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """The intermediate tables of one run of an operator.

    A table outlives the executors that made it, so a lost executor costs no recomputation beyond
    its running tasks.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.catalog = spark, [], {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Cut lineage: write ``df`` as Parquet to the shared folder and read it back."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def observed(self, df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, Any]]:
        """``written``, and aggregates of the rows that the write took along."""
        seen = Observation()
        table = self.written(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), name)
        return table, seen.get

    def bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """Like ``written``, dealt by ``column`` into ``buckets`` files a task, so that later groups and joins on it move nothing."""
        table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{table}"
        df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
        self.catalog[path] = table
        found = self.spark.table(table)
        self.tables.append((found, path))
        return found

    def clear(self, *keep: DataFrame) -> None:
        """Delete all tables but those that a result still reads."""
        held = [(t, p) for t, p in self.tables if any(t is k for k in keep)]
        for table, path in self.tables:
            if not any(table is k for k in keep):
                if path in self.catalog:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.catalog.pop(path)}")
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.tables = held


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the folder's owner clears it."""
    return Scratch(df.sparkSession).written(df, name)
