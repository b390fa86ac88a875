"""Scans of stored snapshots and of reference sets, and immutable writes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OBSERVATION = "report_id string, received_date date, drug_name string, drug_role string, reaction string, serious boolean, patient_age_group string, patient_sex string"

REFERENCES = (
    "reference_set_id string, entries array<struct<reference_id: string, signal_quarter: string, publication_quarter: string, normalized_drug: string, normalized_event: string, normalized_drugs: array<string>, "
    "normalized_events: array<string>, match_method: string, review_status: string, reviewed_by: string, reviewed_at: string>>"
)


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """page, index, payload of every record of page-*.json files (response.results), in a stable order.

    Raises if no page matches. A page whose results are no list fails when it is read.
    """
    pages = spark.read.text(f"{path.rstrip('/')}/page-*.json", wholetext=True)
    results = F.from_json("value", "response struct<results: array<string>>")["response"]["results"]
    checked = F.coalesce(results, F.raise_error(F.lit("response.results must be a list")).cast("array<string>"))
    return pages.select(F.col("_metadata.file_name").alias("page"), F.posexplode(checked).alias("index", "payload")).select("page", F.col("index").cast("long"), "payload")


def first_bad_lines(spark: SparkSession, path: str, bad: Column) -> DataFrame:
    """file, line (from 1), value: the first line of every split of the text files at ``path`` for which ``bad`` (of column value) holds.

    Splits of a file do not know their first line's number: every split counts its lines, and the
    counts of the splits before are added up. One pass, of which each split leaves one row.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    wrong = F.when(bad, F.col("at"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("at").alias("first"), F.min(wrong).alias("wrong"), F.min_by("value", wrong).alias("value"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return splits.withColumn("line", before + F.col("wrong") - F.col("first") + 1).where("wrong is not null").select("file", "line", "value")


def observations(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Curated JSON lines as report_id, received_date, drug, event, ...; empty lines are skipped.

    A line that is no JSON object, holds a value of another kind, or lacks a report, date, drug or
    event is refused: ``check`` reads the files once more before and names the first one by file and
    line; without it the read itself fails, on the line's text.
    """
    row = F.from_json("value", f"{OBSERVATION}, _wrong string", {"columnNameOfCorruptRecord": "_wrong"})
    needed = [row["_wrong"].isNotNull(), *[row[c].isNull() for c in ("report_id", "received_date", "drug_name", "reaction")]]
    bad = (F.col("value") != "") & F.coalesce(reduce(or_, needed), F.lit(True))
    found = first_bad_lines(spark, path, bad).orderBy("file", "line").first() if check else None
    if found:
        raise ValueError(f"invalid curated row at line {found.line} of {found.file}")
    said = F.when(bad, F.raise_error(F.concat(F.lit("invalid curated row: "), F.substring("value", 1, 200)))).otherwise(F.col("value")).alias("value")
    rows = spark.read.text(path).where("value <> ''").select(said).select(F.from_json("value", OBSERVATION).alias("r")).select("r.*")
    return rows.withColumnsRenamed({"drug_name": "drug", "reaction": "event", "patient_age_group": "age_group", "patient_sex": "sex"})


def reference_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a reference set, numbered in file order; fields that a file lacks are null."""
    return spark.read.schema(REFERENCES).option("multiLine", True).option("mode", "FAILFAST").json(path).select("reference_set_id", F.posexplode("entries").alias("entry", "e")).select("reference_set_id", "entry", "e.*")


def evidence_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("document_id string, title string, publisher string, url string, published_date date, content string").option("multiLine", True).json(path)


def comparators(spark: SparkSession, path: str) -> DataFrame:
    """drug, comparator rows of a {drug: [comparators]} file."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("drug", "list"))
    return rows.select("drug", F.explode("list").alias("comparator"))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a table once; a snapshot that exists is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def write_lines(df: DataFrame, path: str, order: list[str] | tuple[str, ...] = ()) -> None:
    """Write a table once as JSON lines, in order: keys sorted, no spaces, nulls kept, infinities as null."""
    whole = df.orderBy(*order) if order else df
    finite = [F.when(F.abs(F.col(f.name)) < float("inf"), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    whole.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)
