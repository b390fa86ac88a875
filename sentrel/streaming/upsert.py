"""Extension (the batch operators have no streaming counterpart elsewhere): latest report versions of a stream of raw pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sentrel.operators.quality import latest, validate_reports

COLUMNS = "page string, index long, report_id string, version long, payload string"


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """page, index, payload of every page file as it arrives."""
    pages = spark.readStream.option("wholetext", True).text(path)
    results = F.from_json("value", "response struct<results: array<string>>")["response"]["results"]
    return pages.select(F.col("_metadata.file_name").alias("page"), F.posexplode(results).alias("index", "payload")).select("page", F.col("index").cast("long"), "payload")


def _parts(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that were written to the end under a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/n=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found)


def current(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    """The winners of all batches (up to a number): the newest base and the batches after it; none before the first."""
    held = [n for n in _parts(spark, f"{table}/base") if upto is None or n <= upto]
    after = [n for n in _parts(spark, f"{table}/delta") if (not held or n > held[-1]) and (upto is None or n <= upto)]
    paths = [f"{table}/base/n={n}" for n in held[-1:]] + [f"{table}/delta/n={n}" for n in after]
    rows = spark.read.schema(COLUMNS).parquet(*paths) if paths else spark.createDataFrame([], COLUMNS)
    return latest(rows, "report_id", "version", ["page", "index"])


def upsert_latest(pages: DataFrame, table: str, checkpoint: str, compact_every: int = 20) -> StreamingQuery:
    """Keep the winners of each batch under ``table``/delta; ``current`` reads the winners of all.

    A batch writes only its own winners. Every ``compact_every`` batches, what holds so far becomes a new
    base, so a reader opens few folders and a batch's work does not grow with the table. A replayed
    batch overwrites only its own folders, and folders that were not finished are not read.
    """

    def merged(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = validate_reports(batch).where("size(reasons) = 0").select("page", "index", "report_id", "version", "payload")
        latest(new, "report_id", "version", ["page", "index"]).write.mode("overwrite").parquet(f"{table}/delta/n={number}")
        if (number + 1) % compact_every == 0:
            current(spark, table, number).write.mode("overwrite").parquet(f"{table}/base/n={number}")

    handler: Callable[[DataFrame, int], None] = merged
    return pages.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
