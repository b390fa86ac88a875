"""The stages as jobs over a data folder: each reads the tables of the one before and writes its own once.

Tables are Parquet under ``root``/<layer>/<source>/<snapshot>/<table>; raw snapshots are page files.
A job returns how many rows each of its tables holds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sentrel.operators import adjusted, backtest, contingency, detectors, evidence, forest, quality, reference, temporal
from sentrel.operators.serve import safe_identifier
from sentrel.sources import snapshots
from sentrel.sources.scratch import written

KEY = ["drug", "event"]
#: The detectors of a backtest: the statistics and the walk-forward forest.
DETECTORS = [*backtest.STATISTICS, "isolation_forest"]

#: In what order the rows of a table are exported.
ORDERS = {
    "accepted": ("report_id", "version"), "pairs": ("report_id", "drug", "event"), "features": ("quarter", "drug", "event"), "temporal_signals": ("quarter", "drug", "event"), "profiles": ("report_id",), "stratum_cells": ("drug", "event", "stratum"),
    "strata": ("drug", "event", "stratum"), "adjusted": ("drug", "event"), "rankings": ("quarter", "detector", "rank"), "quarter_metrics": ("quarter", "detector"), "detector_summary": ("detector",), "briefs": ("drug", "event"),
}


class Store:
    """Paths of one source's snapshot; identifiers that could leave the folder are refused."""

    def __init__(self, spark: SparkSession, root: str, snapshot: str, source: str = "reports"):
        self.spark, self.root, self.place = spark, root.rstrip("/"), f"{safe_identifier(source)}/{safe_identifier(snapshot)}"

    def path(self, layer: str, table: str = "") -> str:
        return f"{self.root}/{layer}/{self.place}/{table}".rstrip("/")

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer, table))

    def write(self, layer: str, tables: dict[str, DataFrame]) -> dict[str, int]:
        counts = {}
        for name, df in tables.items():
            rows = Observation()
            snapshots.write_snapshot(df.observe(rows, F.count(F.lit(1)).alias("n")), self.path(layer, name))
            counts[name] = rows.get["n"]
        return counts


def curated_observations(store: Store) -> DataFrame:
    """Curated rows with the names that operators take, and the year of the report."""
    rows = store.read("curated", "pairs").withColumnsRenamed({"drug_name": "drug", "reaction": "event", "patient_age_group": "age_group", "patient_sex": "sex"})
    return rows.withColumn("year", F.year("received_date"))


def process(spark: SparkSession, root: str, snapshot: str, as_of: dt.date, source: str = "reports") -> dict[str, int]:
    """Page files to accepted and rejected records, curated rows, and the quality report.

    ``as_of`` dates the snapshot for the freshness check.
    """
    store = Store(spark, root, snapshot, source)
    got = quality.processor(source)(snapshots.raw_pages(spark, store.path("raw")), as_of)
    counts = store.write("validated", {"accepted": got["accepted"], "rejected": got["rejected"]})
    counts |= store.write("curated", {"pairs" if source == "reports" else "samples": got["curated"]})
    return counts | store.write("quality", {"metrics": got["metrics"], "checks": got["checks"]})


def score(spark: SparkSession, root: str, snapshot: str, require_checks: bool = False) -> dict[str, int]:
    """Curated rows to ranked signals; ``require_checks`` refuses a snapshot that failed a quality check."""
    store = Store(spark, root, snapshot)
    if require_checks and not store.read("quality", "checks").where("status = 'fail'").isEmpty():
        raise ValueError("the snapshot failed a quality check")
    return store.write("analytics", {"signals": detectors.ranked(detectors.score(contingency.contingency(curated_observations(store))))})


def find_changes(spark: SparkSession, root: str, snapshot: str, contamination: float = forest.CONTAMINATION, minimum_history: int = temporal.MINIMUM_HISTORY) -> dict[str, int]:
    """Curated rows to quarterly features, then anomalies, changes and the model's trees."""
    store = Store(spark, root, snapshot)
    counts = store.write("analytics", {"features": temporal.quarterly_features(curated_observations(store))})
    features = store.read("analytics", "features")
    scaled = written(temporal.robust_scale(features), "scaled-features")
    grown = forest.grow(scaled)
    found = forest.isolation_forest(features, contamination, grown=grown, scaled=scaled)
    keys = [*KEY, "quarter"]
    rows = features.join(found, keys).join(temporal.change_points(features, minimum_history), keys).join(temporal.contributions(scaled), keys)
    trees = spark.createDataFrame(grown[0], forest.NODES)
    return counts | store.write("analytics", {"temporal_signals": rows, "forest": trees})


def evaluate(spark: SparkSession, root: str, snapshot: str, reference_set: str, k: int) -> dict[str, int]:
    """Features and a reference set to rankings, metrics by quarter, a summary by detector, and coverage."""
    store = Store(spark, root, snapshot)
    features = store.read("analytics", "features")
    entries = snapshots.reference_entries(spark, reference_set).withColumnsRenamed({"normalized_drug": "drug", "normalized_event": "event"})
    if not reference.unfit(entries).isEmpty():
        raise ValueError("a reference's pair contradicts its match, or its quarter is missing")
    known = backtest.in_window(entries, features)
    scores = backtest.detector_scores(features, forest.walk_forward(features))
    counts = store.write("analytics", {"detector_scores": scores})
    scores = store.read("analytics", "detector_scores")
    return counts | store.write("analytics", {
        "rankings": backtest.rankings(scores, known), "quarter_metrics": backtest.quarter_metrics(features, scores, known, k, DETECTORS),
        "detector_summary": backtest.detector_summary(features, scores, known, k, DETECTORS), "coverage": backtest.coverage(entries, features),
    })


def adjust(spark: SparkSession, root: str, snapshot: str, comparator_set: str | None = None) -> dict[str, int]:
    """Curated rows to every pair's sensitivity estimates, and the estimates of its strata.

    Pairs without comparators have a null active-comparator estimate.
    """
    store = Store(spark, root, snapshot)
    rows = adjusted.profiles(curated_observations(store))
    store.write("analytics", {"profiles": rows, "stratum_cells": adjusted.stratum_tables(rows)})
    rows, tables = contingency.whole(store.read("analytics", "profiles")), store.read("analytics", "stratum_cells")
    cells = contingency.tables(rows, pairs="report")
    counts = store.write("analytics", {"strata": adjusted.stratum_estimates(tables)})
    strata = store.read("analytics", "strata")

    def named(df: DataFrame, name: str, estimate: str = "estimate") -> DataFrame:
        return df.select(*KEY, *[F.col(c).alias(f"{name}_{e}") for c, e in ((estimate, "estimate"), ("lower_bound", "lower"), ("upper_bound", "upper")) if c in df.columns])

    sets = snapshots.comparators(spark, comparator_set) if comparator_set else spark.createDataFrame([], "drug string, comparator string")
    parts = [
        named(adjusted.mantel_haenszel(tables), "mantel_haenszel"), named(adjusted.active_comparator(rows, sets), "active_comparator"), named(adjusted.penalized_logistic(rows), "logistic"),
        named(adjusted.beta_binomial(cells), "beta_binomial"), adjusted.heterogeneity_p(adjusted.heterogeneity(strata)),
    ]
    out = named(adjusted.crude(cells), "crude", "ror")
    for part in parts:
        out = out.join(part, KEY, "left")
    return counts | store.write("analytics", {"adjusted": out})


def brief(spark: SparkSession, root: str, snapshot: str, pairs: list[tuple[str, str]], evidence_set: str) -> dict[str, int]:
    """Cited briefs of pairs that have signals; a brief that breaks a rule becomes an abstention."""
    store = Store(spark, root, snapshot)
    asked = spark.createDataFrame([(d.upper(), e.upper()) for d, e in pairs], "drug string, event string")
    evidence.require_signals(asked, store.read("analytics", "signals"))
    found = evidence.retrieve(snapshots.evidence_documents(spark, evidence_set), asked)
    return store.write("analytics", {"briefs": evidence.fail_closed(evidence.template_briefs(asked, found))})


def export(spark: SparkSession, root: str, snapshot: str, layer: str, table: str, source: str = "reports") -> dict[str, int]:
    """A finished table as JSON lines in its own order, under export/<source>/<snapshot>/<table>; signals in rank order."""
    store = Store(spark, root, snapshot, source)
    rows = store.read(safe_identifier(layer), safe_identifier(table))
    rows = detectors.ranked(rows) if table == "signals" else rows
    snapshots.write_lines(rows, store.path("export", table), [c for c in ORDERS.get(table, ()) if c in rows.columns])
    return {table: rows.count()}


def check_references(spark: SparkSession, reference_set: str, quarter: str, output: str | None = None) -> dict[str, int]:
    """Entries by eligibility at a quarter, also as a file on request; a set that contradicts itself is refused."""
    entries = snapshots.reference_entries(spark, reference_set)
    bad = reference.inconsistencies(entries).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.reference_id}: {r.problem}" for r in bad))
    counts = reference.eligibility_counts(entries, quarter)
    if output:
        snapshots.write_lines(counts, output, ["reason"])
    return {r.reason: r.entries for r in counts.collect()}


def demonstration(spark: SparkSession) -> DataFrame:
    """98 synthetic reports of one row each over four quarters; one pair grows in the last."""
    per_quarter = {("DRUG A", "EVENT X"): (4, 4, 4, 14), ("DRUG A", "EVENT Y"): (3, 3, 3, 3), ("DRUG B", "EVENT X"): (3, 3, 3, 3), ("DRUG B", "EVENT Y"): (12, 12, 12, 12)}
    rows = [(f"{d}-{e}-{q}-{i}", dt.date(2025, 3 * q + 2, 1 + i), d, "primary_suspect", e, i % 3 == 0, "18-44" if i % 2 else "65+", "female", 0) for (d, e), sizes in per_quarter.items() for q, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "report_id string, received_date date, drug_name string, drug_role string, reaction string, serious boolean, patient_age_group string, patient_sex string, position int")


def demo(spark: SparkSession, root: str, snapshot: str = "demo") -> dict[str, int]:
    """All analytics over the synthetic reports."""
    counts = Store(spark, root, snapshot).write("curated", {"pairs": demonstration(spark)})
    return counts | score(spark, root, snapshot) | find_changes(spark, root, snapshot) | adjust(spark, root, snapshot)
