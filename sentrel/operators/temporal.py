"""Quarterly features of pairs and changes against their own history."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.functions import statistics as st
from sentrel.functions.normalize import quarter_end

from .contingency import Terms, counts, gathered, parts
from .order import quantiles

MINIMUM_HISTORY, CHANGE_CUT, MAD_SCALE = 3, 3.5, 1.4826
QUARTILES = (0.25, 0.5, 0.75)
FEATURES = ("report_count", "reporting_share", "growth", "serious_proportion", "log_ror", "log_prr")


def _dense(counted: DataFrame) -> DataFrame:
    """drug, event, quarter, a, b, c, d, n, marked, before of every shown pair in every quarter; before: a of the last quarter.

    The counts of a pair, a drug and an event are one row each, with a map by quarter. They are joined
    as they are, and a pair's row is laid out by quarter last, so the grid of pairs and quarters is
    neither shuffled nor sorted.
    """
    pairs, per_drug, per_event, total = parts(counted)
    by_quarter = lambda *values: F.map_from_entries(F.collect_list(F.struct("quarter", *values)))
    rows = pairs.groupBy("drug", "event").agg(by_quarter(F.struct("a", "marked")).alias("cells"), F.sum("shown").alias("shown")).where("shown > 0")
    rows = rows.join(per_drug.groupBy("drug").agg(by_quarter("nd").alias("nds")), "drug").join(per_event.groupBy("event").agg(by_quarter("ne").alias("nes")), "event")
    # one row: the quarters that have reports
    rows = rows.crossJoin(F.broadcast(total.agg(F.array_sort(F.collect_list(F.struct("quarter", "n"))).alias("quarters"))))
    rows = rows.select("drug", "event", "cells", "nds", "nes", "quarters", F.posexplode("quarters").alias("_i", "_q"))
    at = lambda column, quarter: F.element_at(column, quarter)
    this, last = F.col("_q.quarter"), F.get("quarters", F.col("_i") - 1)["quarter"]
    found = {"a": at("cells", this)["a"], "nd": at("nds", this), "ne": at("nes", this), "marked": at("cells", this)["marked"], "before": at("cells", last)["a"]}
    rows = rows.select("drug", "event", this.alias("quarter"), F.col("_q.n").alias("n"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in found.items()])
    return rows.select("drug", "event", "quarter", "a", (F.col("nd") - F.col("a")).alias("b"), (F.col("ne") - F.col("a")).alias("c"), (F.col("n") - F.col("nd") - F.col("ne") + F.col("a")).alias("d"), "n", "marked", "before")


def quarterly_features(obs: DataFrame, terms: Terms | None = None) -> DataFrame:
    """Every pair that rows show in every quarter that has reports, quarters without the pair included.

    ``serious_proportion`` divides reports with a serious row of the pair by reports that hold both;
    growth is against the quarter before among those with reports (from 0 in the first). With
    ``terms`` drugs and events of the rows are numbers of these.
    """
    # until reports are counted, a quarter is a number (4 a year), which is quicker made and told apart than its label
    number = F.year("received_date") * 4 + F.floor((F.month("received_date") - 1) / 3).cast("int")
    label = F.concat(F.floor(F.col("quarter") / 4).cast("string"), F.lit("-Q"), (F.pmod("quarter", F.lit(4)) + 1).cast("string"))
    obs = obs.where("received_date is not null").withColumn("quarter", number)
    rows = _dense(counts(gathered(obs, ["quarter"], F.col("serious"), terms), ["quarter"], terms=terms).withColumn("quarter", label))
    before = F.col("before")
    first_day = F.make_date(F.substring("quarter", 1, 4).cast("int"), F.substring("quarter", -1, 1).cast("int") * 3, F.lit(1))
    return rows.select(
        "drug", "event", "quarter", quarter_end(first_day).alias("quarter_end"), F.col("a").alias("report_count"), F.col("n").alias("total_reports"),
        (F.col("a") / F.col("n")).alias("reporting_share"), ((F.col("a") - before) / F.greatest(before, F.lit(1))).cast("double").alias("growth"),
        F.when(F.col("a") > 0, F.col("marked") / F.nullif("a", F.lit(0))).otherwise(0.0).alias("serious_proportion"), st.ror().alias("ror"), st.prr().alias("prr"),
    )


class History:
    """Median and MAD of a growing list of numbers, which is kept sorted: memory is linear, a look takes logarithmic time."""

    def __init__(self) -> None:
        self.values: list[float] = []

    def add(self, value: float) -> None:
        insort(self.values, value)

    def median(self) -> float:
        v, n = self.values, len(self.values)
        return (v[(n - 1) // 2] + v[n // 2]) / 2.0

    def _nearest(self, k: int, middle: float, split: int) -> float:
        """The k-th smallest distance (from 0) to ``middle``: of two sorted runs, those below it from behind and those above."""
        v, low, high = self.values, max(0, k + 1 - (len(self.values) - split)), min(k + 1, split)
        while low < high:  # how many of the k + 1 nearest lie below
            some = (low + high) // 2
            # one more from below is nearer than the last that is taken from above
            if k - some >= 0 and middle - v[split - 1 - some] < v[split + k - some] - middle:
                low = some + 1
            else:
                high = some
        below = middle - v[split - low] if low else -1.0
        above = v[split + k - low] - middle if k + 1 > low else -1.0
        return max(below, above)

    def mad(self, middle: float) -> float:
        n, split = len(self.values), bisect_right(self.values, middle)
        return (self._nearest((n - 1) // 2, middle, split) + self._nearest(n // 2, middle, split)) / 2.0


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Median, MAD and number of the earlier counts of every row; rows come sorted by pair and quarter."""
    pair, past = None, History()
    for batch in batches:
        middles, mads, sizes = [], [], []
        for drug, event, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (drug, event) != pair:
                pair, past = (drug, event), History()
            n = len(past.values)
            middle = past.median() if n else None
            middles.append(middle)
            mads.append(past.mad(middle) if n else None)
            sizes.append(n)
            past.add(float(count))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(middles, pa.float64()), pa.array(mads, pa.float64()), pa.array(sizes, pa.int64())], names=["drug", "event", "quarter", "report_count", "middle", "mad", "n"])


def change_points(features: DataFrame, minimum_history: int = MINIMUM_HISTORY) -> DataFrame:
    """drug, event, quarter, change_score, is_change_point, baseline_quarters.

    The report count against median and MAD of strictly earlier quarters, upward only. A pair's
    quarters are sorted once and its counts carried along in order, so a long history takes memory in
    proportion to it.
    """
    rows = features.select("drug", "event", "quarter", F.col("report_count").cast("long").alias("report_count"))
    walked = rows.repartition("drug", "event").sortWithinPartitions("drug", "event", "quarter").mapInArrow(_carried, "drug string, event string, quarter string, report_count long, middle double, mad double, n long")
    score = F.when(F.col("n") >= max(minimum_history, 1), (F.col("report_count") - F.col("middle")) / F.greatest(MAD_SCALE * F.col("mad"), F.lit(1.0))).otherwise(0.0)
    return walked.select("drug", "event", "quarter", score.alias("change_score"), (score >= CHANGE_CUT).alias("is_change_point"), F.col("n").alias("baseline_quarters"))


def vector_columns() -> list[Column]:
    """The six model features of a row of ``quarterly_features``, in order."""
    return [F.col("report_count").cast("double").alias("report_count"), F.col("reporting_share"), F.col("growth"), F.col("serious_proportion"), F.log1p("ror").alias("log_ror"), F.log1p("prr").alias("log_prr")]


def robust_scale(features: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """The features less their median, over their interquartile range (1 if that is 0), as scaled_<name>.

    Exact, interpolated quartiles of ``fitted_on`` (by default the rows themselves), which are found
    here: both are read at once, so the caller writes what is costly to make again.
    """
    found = quantiles((features if fitted_on is None else fitted_on).select(*vector_columns()), FEATURES, QUARTILES).get((), {})
    return scaled_by(features.select("drug", "event", "quarter", *vector_columns()), {x: [F.lit(v) for v in found.get(x, [0.0] * 3)] for x in FEATURES})


def scaled_by(rows: DataFrame, quartiles: dict[str, list[Column]], *keep: str) -> DataFrame:
    """Rows of features scaled by the quartiles of each."""
    spread = lambda x: quartiles[x][2] - quartiles[x][0]
    return rows.select("drug", "event", "quarter", *keep, *[((F.col(x) - quartiles[x][1]) / F.when(spread(x) == 0, 1.0).otherwise(spread(x))).alias(f"scaled_{x}") for x in FEATURES])


def contributions(scaled: DataFrame) -> DataFrame:
    """drug, event, quarter, contributions: features by absolute scaled deviation (6 places), largest first, ties in feature order."""
    entries = F.array(*[F.struct((-F.round(F.abs(F.col(f"scaled_{x}")), 6)).alias("minus"), F.lit(i).alias("place"), F.lit(x).alias("name")) for i, x in enumerate(FEATURES)])
    return scaled.select("drug", "event", "quarter", F.transform(F.array_sort(entries), lambda e: F.struct(e["name"].alias("name"), (-e["minus"]).alias("value"))).alias("contributions"))
