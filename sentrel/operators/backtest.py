"""Walk-forward ranking evaluation of detectors against dated reference signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions.normalize import quarter_ordinal
from sentrel.sources.scratch import Scratch

from .order import placed

STATISTICS = ("report_count", "ror", "prr")


def detector_scores(features: DataFrame, forest_scores: DataFrame | None = None) -> DataFrame:
    """quarter, detector, drug, event, score: the statistics of the same quarter, and forest scores where there are any."""
    rows = features.select("quarter", "drug", "event", *[F.col(x).cast("double") for x in STATISTICS]).unpivot(["quarter", "drug", "event"], list(STATISTICS), "detector", "score")
    return rows if forest_scores is None else rows.unionByName(forest_scores.select("quarter", "drug", "event", F.lit("isolation_forest").alias("detector"), "score"))


def in_window(references: DataFrame, features: DataFrame) -> DataFrame:
    """Matched references whose quarter the features cover."""
    return references.where("match_method <> 'unmatched'").join(features.select(F.col("quarter").alias("signal_quarter")).distinct(), "signal_quarter", "left_semi")


def rankings(scores: DataFrame, references: DataFrame) -> DataFrame:
    """Ranks from 1 within quarter and detector (score, then drug and event), with the references of the same quarter in entry order.

    All pairs of a quarter are ranked across partitions, so no task sorts them alone.
    """
    known = references.groupBy(F.col("signal_quarter").alias("quarter"), "drug", "event").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "reference_id"))), lambda e: e["reference_id"]).alias("matched"))
    ranked = placed(scores, ["quarter", "detector"], [F.desc("score"), "drug", "event"], Scratch(scores.sparkSession), "rank")
    return ranked.join(known, ["quarter", "drug", "event"], "left").select("quarter", "detector", F.col("rank").cast("int").alias("rank"), "drug", "event", "score", F.col("matched").isNotNull().alias("is_reference_signal"), F.coalesce("matched", F.array().cast("array<string>")).alias("matched_reference_ids"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each quarter and detector: the alerts (only the k best travel)."""
    place = Window.partitionBy("quarter", "detector").orderBy(F.desc("score"), "drug", "event")
    return scores.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _groups(features: DataFrame, scores: DataFrame, detectors: list[str]) -> DataFrame:
    """quarter, detector, available: every quarter with every detector."""
    grid = features.select("quarter").distinct().withColumn("detector", F.explode(F.array(*map(F.lit, detectors))))
    return grid.join(scores.select("quarter", "detector").distinct().withColumn("there", F.lit(True)), ["quarter", "detector"], "left").select("quarter", "detector", F.coalesce("there", F.lit(False)).alias("available"))


def quarter_metrics(features: DataFrame, scores: DataFrame, references: DataFrame, k: int, detectors: list[str]) -> DataFrame:
    """Hits count references, not pairs; recall needs references, precision needs both alerts and references."""
    alerts = top_k(scores, k)
    wanted = references.select(F.col("signal_quarter").alias("quarter"), "drug", "event", "reference_id")
    eligible = wanted.groupBy("quarter").agg(F.count("*").alias("eligible"))
    raised = alerts.groupBy("quarter", "detector").agg(F.count("*").alias("alerts"))
    hits = alerts.join(wanted, ["quarter", "drug", "event"]).groupBy("quarter", "detector").agg(F.count("*").alias("hits"))
    rows = _groups(features, scores, detectors).join(eligible, "quarter", "left").join(raised, ["quarter", "detector"], "left").join(hits, ["quarter", "detector"], "left").na.fill(0, ["eligible", "alerts", "hits"])
    recall, precision = F.try_divide(F.col("hits").cast("double"), F.col("eligible")), F.when(F.col("eligible") > 0, F.try_divide(F.col("hits").cast("double"), F.col("alerts")))
    return rows.select("quarter", "detector", "available", F.lit(k).alias("k"), "eligible", "hits", "alerts", recall.alias("recall_at_k"), precision.alias("precision_at_k"))


def lead_times(scores: DataFrame, references: DataFrame, k: int | None) -> DataFrame:
    """detector, reference_id, lead_quarters: from the first alert at or before the reference's quarter.

    ``k`` of None takes every scored pair as an alert. A pair's first alert is found before references
    are looked at (a later one cannot be the first for any), so a pair that alerts in every quarter
    meets its references once a detector.
    """
    alerts = scores if k is None else top_k(scores, k)
    first = alerts.groupBy("detector", "drug", "event").agg(F.min("quarter").alias("alert_quarter"))
    joined = first.join(references, ["drug", "event"]).where("alert_quarter <= signal_quarter")
    return joined.groupBy("detector", "reference_id", "signal_quarter").agg(F.min("alert_quarter").alias("alert_quarter")).select("detector", "reference_id", (quarter_ordinal(F.col("signal_quarter")) - quarter_ordinal(F.col("alert_quarter"))).alias("lead_quarters"))


def detector_summary(features: DataFrame, scores: DataFrame, references: DataFrame, k: int, detectors: list[str]) -> DataFrame:
    """Per detector over the quarters in which it was available; precision is hits over all alerts."""
    metrics = quarter_metrics(features, scores, references, k, detectors).where("available")
    sums = metrics.groupBy("detector").agg(F.count("*").alias("evaluated_quarters"), F.sum("eligible").alias("eligible_references"), F.sum("hits").alias("hits"), F.sum("alerts").alias("alert_burden"))
    named = _groups(features, scores, detectors).select("detector").distinct()
    usable = metrics.select("detector", F.col("quarter").alias("signal_quarter"))
    leads = lead_times(scores, references, k).join(references.select("reference_id", "signal_quarter"), "reference_id").join(usable, ["detector", "signal_quarter"], "left_semi")
    leads = leads.groupBy("detector").agg(F.median("lead_quarters").alias("median_lead_quarters"), F.count("*").alias("detected_with_lead_time"))
    rows = named.join(sums, "detector", "left").join(leads, "detector", "left").na.fill(0, ["evaluated_quarters", "eligible_references", "hits", "alert_burden", "detected_with_lead_time"])
    return rows.withColumns({"recall_at_k": F.try_divide(F.col("hits").cast("double"), F.col("eligible_references")), "precision_at_k": F.try_divide(F.col("hits").cast("double"), F.col("alert_burden"))})


def coverage(references: DataFrame, features: DataFrame) -> DataFrame:
    """match_method, entries, out_of_window of a reference set."""
    quarters = features.select(F.col("quarter").alias("signal_quarter")).distinct().withColumn("covered", F.lit(True))
    rows = references.join(quarters, "signal_quarter", "left")
    return rows.groupBy("match_method").agg(F.count("*").alias("entries"), F.count_if(F.col("covered").isNull() & (F.col("match_method") != "unmatched")).alias("out_of_window"))
