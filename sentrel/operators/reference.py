"""Benchmark references: consistency and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions.normalize import quarter_ordinal

REASONS = ("not_independently_reviewed", "unmatched_terminology", "not_yet_published", "eligible")


def eligibility(quarter: str) -> Column:
    """The first reason that keeps an entry out at an analysis quarter, or eligible."""
    return (
        F.when(F.col("review_status") != "independently_reviewed", REASONS[0])
        .when(F.col("match_method") == "unmatched", REASONS[1])
        .when(quarter_ordinal(F.col("publication_quarter")) > quarter_ordinal(F.lit(quarter)), REASONS[2])
        .otherwise(REASONS[3])
    )


def eligibility_counts(entries: DataFrame, quarter: str) -> DataFrame:
    return entries.groupBy(eligibility(quarter).alias("reason")).agg(F.count("*").alias("entries"))


def unfit(entries: DataFrame) -> DataFrame:
    """Entries of a backtest set (drug, event, match_method, signal_quarter) whose pair contradicts their match, or without a quarter."""
    paired = F.col("drug").isNotNull() & F.col("event").isNotNull()
    loose = F.col("drug").isNull() & F.col("event").isNull()
    fine = F.when(F.col("match_method") == "unmatched", loose).otherwise(paired) & F.col("signal_quarter").rlike(r"^[0-9]{4}-Q[1-4]$")
    return entries.where(~F.coalesce(fine, F.lit(False)))


def inconsistencies(entries: DataFrame) -> DataFrame:
    """reference_id, problem: repeated identifiers, and mappings or reviews that contradict the status."""
    mapped = (F.size(F.coalesce("normalized_drugs", F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce("normalized_events", F.array().cast("array<string>"))) > 0)
    reviewed = F.col("review_status") == "independently_reviewed"
    problems = F.array(
        F.when((F.col("match_method") != "unmatched") & ~mapped, "matched without mapping"),
        F.when((F.col("match_method") == "unmatched") & mapped, "unmatched with mapping"),
        F.when(reviewed & (F.col("reviewed_by").isNull() | F.col("reviewed_at").isNull()), "reviewed without reviewer or time"),
        F.when(reviewed & ~mapped, "reviewed without mapping"),
    )
    rows = entries.select("reference_id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))
    repeated = entries.groupBy("reference_id").agg(F.count("*").alias("n")).where("n > 1").select("reference_id", F.lit("repeated identifier").alias("problem"))
    return rows.unionByName(repeated)
