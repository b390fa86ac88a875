"""Contract of longitudinal cohorts (no estimator is part of it)."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASELINE_DAYS = 180


def timeline_violations(people: DataFrame) -> DataFrame:
    """person_id, violation: dates out of order, outcomes outside follow-up, impossible ages."""
    checks = F.array(
        F.when((F.col("exposure_start") < F.col("observation_start")) | (F.col("exposure_start") > F.col("observation_end")), "exposure outside observation"),
        F.when((F.col("outcome_date") < F.col("exposure_start")) | (F.col("outcome_date") > F.col("observation_end")), "outcome outside follow-up"),
        F.when((F.col("age") < 0) | (F.col("age") > 130), "age out of range"),
    )
    return people.select("person_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("violation"))


def set_violations(people: DataFrame, baseline_days: int = BASELINE_DAYS) -> DataFrame:
    """violation, found: rules of the whole set that fail (empty, repeated person, not two cohorts, short baseline)."""
    sums = people.agg(F.count("*").alias("n"), F.count_distinct("person_id").alias("people"), F.count_distinct("cohort").alias("cohorts"), F.count_if(F.datediff("exposure_start", "observation_start") < baseline_days).alias("short"))
    row = lambda bad, name, found: F.when(bad, F.struct(F.lit(name).alias("violation"), found.cast("long").alias("found")))
    rows = F.array(row(F.col("n") == 0, "empty cohort", F.col("n")), row(F.col("people") < F.col("n"), "repeated person", F.col("n") - F.col("people")), row((F.col("n") > 0) & (F.col("cohorts") != 2), "not two cohorts", F.col("cohorts")), row(F.col("short") > 0, "short baseline", F.col("short")))
    return sums.select(F.inline(F.filter(rows, lambda r: r.isNotNull())))


class LongitudinalEstimator(Protocol):
    """Estimates of a cohort that has neither timeline nor set violations; none ships with the library."""

    def __call__(self, people: DataFrame) -> DataFrame: ...
