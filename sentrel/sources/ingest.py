"""Ingestion of paged sources: pages are rows of an append-only table, and a rerun fetches what is missing.

The table is raw content and checkpoint at once: a page's row holds its place, its records, their
digest and the digest of the manifest that asked for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import Manifest
from .pages import PagedRecords
from .sink import JsonFiles

PAGES = "skip long, records long, payloads array<string>, sha256 string, manifest_digest string"


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that were written; empty before the first run."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], PAGES)
    return spark.read.schema(PAGES).parquet(path)


def digest() -> F.Column:
    """SHA-256 of a page's records."""
    return F.sha2(F.to_json("payloads"), 256)


def verified(pages: DataFrame) -> DataFrame:
    """Pages whose records still have their digest."""
    return pages.where(F.col("sha256") == digest())


def planned(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """skip, limit of every page that a manifest asks for."""
    size, most = manifest["page_size"], manifest["max_records"]
    return spark.range(0, most, size).select(F.col("id").alias("skip"), F.least(F.lit(size), F.lit(most) - F.col("id")).alias("limit"))


def missing(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned pages that are not there, up to the first one that came back short."""
    short = plan.join(done, "skip").where(F.col("records") < F.col("limit")).agg(F.min("skip").alias("end"))
    return plan.join(done, "skip", "left_anti").crossJoin(short).where("end is null or skip < end").select("skip", "limit")


def ingest(spark: SparkSession, root: str, manifest: Manifest, url: str, **options: str) -> dict[str, int]:
    """Fetch the missing pages of a snapshot and append them; counts of fetched and reused pages and of records.

    A snapshot belongs to one manifest. A page that was written and does not verify is fetched anew,
    and refused if its records differ from those that were digested: raw pages never change.
    """
    path = f"{root.rstrip('/')}/raw/{manifest.source}/{manifest['snapshot_id']}/pages"
    there = stored_pages(spark, path)
    if not there.where(F.col("manifest_digest") != manifest.digest).isEmpty():
        raise ValueError("the snapshot was made by another manifest")
    plan, done = planned(spark, manifest), verified(there)
    wanted = [r.skip for r in missing(plan, done).orderBy("skip").collect()]  # a few hundred at most
    reused = done.count()
    if wanted:
        spark.dataSource.register(PagedRecords)
        names = {"search": "search"} if manifest.kind == "openfda" else {"where": "$where", "order": "$order", "select": "$select"}
        asked = {f"param.{to}": manifest[name] for name, to in names.items() if manifest[name] is not None}
        source = spark.read.format("paged_records").options(url=url, interface=manifest.kind, pageSize=str(manifest["page_size"]), maxRecords=str(manifest["max_records"]), offsets=",".join(map(str, wanted)), **asked, **options)
        rows = source.load().groupBy(F.regexp_extract("page", r"(\d+)$", 1).cast("long").alias("skip")).agg(F.array_sort(F.collect_list(F.struct("index", "payload"))).alias("rows"))
        pages = spark.createDataFrame([(s,) for s in wanted], "skip long").join(rows, "skip", "left").select("skip", F.coalesce(F.transform("rows", lambda r: r["payload"]), F.array().cast("array<string>")).alias("payloads"))
        pages = pages.select("skip", F.size("payloads").cast("long").alias("records"), "payloads", digest().alias("sha256"), F.lit(manifest.digest).alias("manifest_digest")).persist()
        changed = pages.alias("new").join(there.alias("old"), "skip").where("new.sha256 <> old.sha256")
        if not changed.isEmpty():
            raise FileExistsError(f"page {changed.first().skip} of a snapshot changed; use a new snapshot_id")
        # pages after a short one hold nothing that belongs to the snapshot
        ends = pages.join(plan, "skip").where(F.col("records") < F.col("limit")).agg(F.min("skip").alias("end"))
        pages.join(there.select("skip"), "skip", "left_anti").crossJoin(ends).where("end is null or skip <= end").select("skip", "records", "payloads", "sha256", "manifest_digest").write.mode("append").parquet(path)
        pages.unpersist()
    after = verified(stored_pages(spark, path))
    return {"fetched_pages": after.count() - reused, "reused_pages": reused, "total_records": after.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]}


def raw_records(pages: DataFrame) -> DataFrame:
    """page, index, payload of every record, as the quality stage takes them."""
    return pages.select(F.format_string("page-%09d", "skip").alias("page"), F.posexplode("payloads").alias("index", "payload")).select("page", F.col("index").cast("long"), "payload")


def export_pages(spark: SparkSession, root: str, manifest: Manifest) -> str:
    """The verified pages of a snapshot as page files (``snapshots.raw_pages`` reads them); their folder.

    A rerun adds what is new; a file whose page changed is refused.
    """
    spark.dataSource.register(JsonFiles)
    base = f"{root.rstrip('/')}/raw/{manifest.source}/{manifest['snapshot_id']}"
    request = F.struct(F.col("skip"), F.lit(manifest["page_size"]).alias("limit"), F.lit(manifest.digest).alias("manifest_digest"))
    results = F.concat(F.lit('{"request":'), F.to_json(request), F.lit(',"response":{"results":['), F.array_join("payloads", ","), F.lit("]}}"))
    pages = verified(stored_pages(spark, f"{base}/pages")).select(F.format_string("page-%09d.json", "skip").alias("name"), results.alias("content"))
    pages.write.format("json_files").mode("append").save(f"{base}/files")
    return f"{base}/files"
