"""Read-only questions to finished tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.functions.normalize import brief_key

from .detectors import ranked

IDENTIFIER = re.compile(r"[a-z0-9][a-z0-9_-]{2,63}")
MOST_ROWS = 1000


def safe_identifier(value: str) -> str:
    """The identifier, if it may be part of a path."""
    if not IDENTIFIER.fullmatch(value):
        raise ValueError(f"not a safe identifier: {value!r}")
    return value


def _is(column: str):
    return lambda value: F.col(column) == value


def _term(column: str):
    return lambda value: F.col(column) == value.upper()


def _flag(column: str):
    return lambda value: F.col(column) if value else F.lit(True)


PAIR = {"drug": _term("drug"), "event": _term("event")}
#: What each kind of table can be asked for, and the order of its answers.
QUESTIONS = {
    "signals": (PAIR | {"detector": _is("detector"), "potential": _flag("is_potential_signal"), "stable": _flag("passes_stability_rule")}, ranked),
    "temporal": (PAIR | {"anomalies": _flag("is_anomaly"), "changes": _flag("is_change_point")}, lambda df: df.orderBy("quarter", "drug", "event")),
    "adjusted": (PAIR, lambda df: df.orderBy("drug", "event")),
}


def answers(kind: str, rows: DataFrame, limit: int = 100, **wanted) -> DataFrame:
    """The first ``limit`` rows of a finished table that meet all conditions (None: no condition), in its order.

    signals: drug, event, detector, potential, stable; temporal: drug, event, anomalies, changes;
    adjusted: drug, event.
    """
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be between 1 and {MOST_ROWS}")
    conditions, order = QUESTIONS[kind]
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(conditions[name](value))
    return order(rows).limit(limit)


def brief(briefs: DataFrame, drug: str, event: str) -> DataFrame:
    """The brief of a pair, whatever its case: found by its key, and only if it is really of that pair."""
    key = brief_key(F.lit(drug), F.lit(event))
    return briefs.where((F.col("brief_key") == key) & (F.upper("drug") == drug.upper()) & (F.upper("event") == event.upper()))


def queue(scores: DataFrame, term: str = "", status: str | None = None) -> DataFrame:
    """Scores whose drug, event or detector contains the term, and whose status (potential or observed) matches."""
    term = term.upper()
    df = scores.withColumn("status", F.when(F.col("is_potential_signal"), "potential").otherwise("observed"))
    df = df.where(F.contains("drug", F.lit(term)) | F.contains("event", F.lit(term)) | F.contains(F.upper("detector"), F.lit(term))) if term else df
    return df.where(F.col("status") == status) if status else df
