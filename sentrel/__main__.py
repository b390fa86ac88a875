"""Command line of the jobs: ``spark-submit`` or ``python -m sentrel <job> --root <folder> ...``; prints one JSON line."""

from __future__ import annotations

import argparse
import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from sentrel.plans import jobs
from sentrel.sources import archives, ingest, manifests


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sentrel")
    sub = top.add_subparsers(dest="job", required=True)

    def job(name: str, snapshot: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if snapshot:
            p.add_argument("--root", required=True)
            p.add_argument("--snapshot", required=name != "demo", default="demo")
        return p

    p = job("process")
    p.add_argument("--source", choices=sorted(jobs.quality.PROCESSORS), default="reports")
    p.add_argument("--as-of", type=dt.date.fromisoformat, required=True)
    job("score").add_argument("--require-checks", action="store_true")
    p = job("temporal")
    p.add_argument("--contamination", type=float, default=jobs.forest.CONTAMINATION)
    p.add_argument("--minimum-history", type=int, default=jobs.temporal.MINIMUM_HISTORY)
    p = job("backtest")
    p.add_argument("--reference-set", required=True)
    p.add_argument("--k", type=int, required=True)
    job("adjust").add_argument("--comparator-set")
    p = job("brief")
    p.add_argument("--drug", required=True)
    p.add_argument("--event", required=True)
    p.add_argument("--evidence-set", required=True)
    p = job("check-references", snapshot=False)
    p.add_argument("--reference-set", required=True)
    p.add_argument("--quarter", required=True)
    p.add_argument("--output")
    p = job("export")
    p.add_argument("--layer", required=True)
    p.add_argument("--table", required=True)
    p.add_argument("--source", choices=sorted(jobs.quality.PROCESSORS), default="reports")
    p = job("ingest", snapshot=False)
    p.add_argument("--root", required=True)
    p.add_argument("--kind", choices=sorted(manifests.KINDS), required=True)
    p.add_argument("--manifest", required=True)
    p.add_argument("--url", required=True)
    p = job("pages", snapshot=False)
    p.add_argument("--root", required=True)
    p.add_argument("--kind", choices=sorted(manifests.KINDS), required=True)
    p.add_argument("--manifest", required=True)
    p = job("archives", snapshot=False)
    p.add_argument("--root", required=True)
    p.add_argument("--manifest", required=True)
    p.add_argument("--quarter", action="append", dest="quarters")
    p.add_argument("--max-bytes", type=int, default=archives.MAX_BYTES)
    job("demo")
    return top


def fetched(spark: SparkSession, root: str, manifest: str, quarters: list[str] | None, max_bytes: int) -> dict[str, int]:
    """Bytes of each archive of a quarterly manifest, fetched or verified one after the other."""
    with open(manifest, encoding="utf-8") as f:
        listed = manifests.archives(json.load(f), quarters)
    return {a["quarter"]: archives.fetch(spark, root, a, max_bytes)["bytes"] for a in listed}


def run(arguments: Sequence[str] | None, spark: SparkSession) -> dict:
    a = parser().parse_args(arguments)
    calls = {
        "process": lambda: jobs.process(spark, a.root, a.snapshot, a.as_of, a.source), "score": lambda: jobs.score(spark, a.root, a.snapshot, a.require_checks),
        "temporal": lambda: jobs.find_changes(spark, a.root, a.snapshot, a.contamination, a.minimum_history), "backtest": lambda: jobs.evaluate(spark, a.root, a.snapshot, a.reference_set, a.k),
        "adjust": lambda: jobs.adjust(spark, a.root, a.snapshot, a.comparator_set), "brief": lambda: jobs.brief(spark, a.root, a.snapshot, [(a.drug, a.event)], a.evidence_set),
        "check-references": lambda: jobs.check_references(spark, a.reference_set, a.quarter, a.output), "export": lambda: jobs.export(spark, a.root, a.snapshot, a.layer, a.table, a.source),
        "ingest": lambda: ingest.ingest(spark, a.root, manifests.load(a.kind, a.manifest), a.url), "demo": lambda: jobs.demo(spark, a.root, a.snapshot),
        "pages": lambda: ingest.export_pages(spark, a.root, manifests.load(a.kind, a.manifest)), "archives": lambda: fetched(spark, a.root, a.manifest, a.quarters, a.max_bytes),
    }
    return {"job": a.job, "rows": calls[a.job]()}


if __name__ == "__main__":
    print(json.dumps(run(None, SparkSession.builder.appName("sentrel").config("spark.sql.session.timeZone", "UTC").getOrCreate())))
