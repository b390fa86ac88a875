"""Signal detectors: each maps a table of cells to scores; more can be registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions import statistics as st

COLUMNS = ["detector", "drug", "event", "score", "lower_bound", "upper_bound", "a", "b", "c", "d", "chi_square", "is_potential_signal", "passes_stability_rule"]
MINIMUM_REPORTS, STABLE_REPORTS, MINIMUM_PRR, MINIMUM_CHI_SQUARE = 3, 5, 2.0, 4.0


def _signal(name: str, score: Column, error: Column, chi_square: Column, potential: Callable[[Column, Column], Column]) -> Column:
    """A detector's result for a row of cells as a struct of ``COLUMNS``; negative cells raise."""
    lower, upper = st.bounds(score, error)
    a = F.col("a")
    bad = F.when(F.least("a", "b", "c", "d") < 0, F.raise_error(F.lit("contingency cells must be non-negative")).cast("double"))
    values = [F.lit(name), F.col("drug"), F.col("event"), F.coalesce(bad, score), lower, upper, a, F.col("b"), F.col("c"), F.col("d"), chi_square, potential(score, lower) & (a >= MINIMUM_REPORTS), (a >= STABLE_REPORTS) & (lower > 1)]
    return F.struct(*[v.alias(n) for v, n in zip(values, COLUMNS, strict=True)])


def ror_signal() -> Column:
    """ROR: potential from 3 reports with the lower bound above 1, stable from 5."""
    return _signal("ror", st.ror(), st.ror_error(), F.lit(None).cast("double"), lambda score, lower: lower > 1)


def prr_signal() -> Column:
    """PRR: potential from 3 reports, a ratio of 2 and a chi-square of 4; stable from 5 with the lower bound above 1."""
    return _signal("prr", st.prr(), st.prr_error(), st.chi_square(), lambda score, lower: (score >= MINIMUM_PRR) & (st.chi_square() >= MINIMUM_CHI_SQUARE))


#: Detectors by name: each gives a struct Column over drug, event and the cells. Add others here or pass them to ``score``.
DETECTORS: dict[str, Callable[[], Column]] = {"ror": ror_signal, "prr": prr_signal}


def score(cells: DataFrame, detectors: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """All detectors' scores of all pairs, in one pass over the cells."""
    return cells.select(F.inline(F.array(*[f() for f in (detectors or DETECTORS).values()])))


def reporting_odds_ratio(cells: DataFrame) -> DataFrame:
    return score(cells, {"ror": ror_signal})


def proportional_reporting_ratio(cells: DataFrame) -> DataFrame:
    return score(cells, {"prr": prr_signal})


def ranked(scores: DataFrame) -> DataFrame:
    """Potential first, then stable, then by score; ties by detector, drug and event."""
    return scores.orderBy(F.desc("is_potential_signal"), F.desc("passes_stability_rule"), F.desc("score"), "detector", "drug", "event")


def totals(scores: DataFrame) -> DataFrame:
    """One row: scores, pairs, potential signals, stable signals."""
    return scores.agg(F.count("*").alias("scores"), F.count_distinct("drug", "event").alias("pairs"), F.count_if("is_potential_signal").alias("potential_signals"), F.count_if("passes_stability_rule").alias("stable_signals"))
