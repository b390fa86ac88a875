"""Places and quantiles of sorted groups, without a task that holds a whole group or a value's rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sentrel.sources.scratch import Scratch

#: Bits of a row's number within its partition.
WITHIN = 33


def _dealt(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], store: Scratch, *apart: Column) -> DataFrame:
    """``rows`` sorted across partitions by group and order, written, with number ``_at`` and partition ``_part``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *by, *order, *apart).sortWithinPartitions(*by, *order, *apart)
    return store.written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "places").withColumn("_part", F.shiftright("_at", WITHIN))


def placed(rows: DataFrame, by: list[str], order: Sequence[Column | str], store: Scratch, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 within the groups ``by`` (not null), in ``order``.

    Rows are sorted across partitions by group and order; what earlier partitions hold of a group is
    added to the place within the partition. The sorted rows are written once to the shared folder.
    Rows that tie are told apart by a hash of all their columns, so ties do not land in one task; rows
    that are equal in every column do (count these first, as ``quantiles`` does).
    """
    table = _dealt(rows, by, order, store, F.xxhash64(*[F.col(c) for c in rows.columns]))
    # a group is one run of rows in each partition that holds it
    runs = table.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0)))
    return table.join(runs, [*by, "_part"]).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))


def _chosen(values: pa.Table, wanted: pa.Table) -> pa.Table:
    """Values of the wanted places of one partition's distinct values (any order), for each point in time."""
    value, since, n = (values.column(c).to_numpy() for c in ("_value", "_since", "_n"))
    order = np.argsort(value, kind="stable")
    value, since, n = value[order], since[order], n[order]
    upto: dict[int, np.ndarray] = {}
    out = []
    for when, place in zip(wanted.column("_when").to_pylist(), wanted.column("_within").to_pylist(), strict=True):
        if when not in upto:
            upto[when] = np.cumsum(np.where(since <= when, n, 0))
        out.append(float(value[np.searchsorted(upto[when], place)]))
    return wanted.append_column("_value", pa.array(out, pa.float64()))


def _quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str], since: Column, times: int) -> dict[tuple, dict[str, list[float]]]:
    """By (group, point in time): quantiles of the values whose ``since`` is not after the point.

    A value is one row, with its count, for each ``since``; no row is copied for later points. Partial
    counts of partitions tell which of them hold the wanted places, and only those are looked into.
    """
    store = Scratch(rows.sparkSession)
    keys = [*by, "_column"]
    values = rows.select(*by, since.cast("int").alias("_since"), *[F.col(c).cast("double") for c in columns]).unpivot([*by, "_since"], list(columns), "_column", "_value")
    values = values.where((F.col("_since") < times) & F.col("_value").isNotNull()).groupBy(*keys, "_value", "_since").agg(F.count("*").alias("_n"))
    table = _dealt(values, keys, ["_value", "_since"], store)
    runs = table.groupBy(*keys, "_part", "_since").agg(F.sum("_n").alias("_n"))
    runs = runs.select(*keys, "_part", F.explode(F.sequence("_since", F.lit(times - 1))).alias("_when"), "_n").groupBy(*keys, "_when", "_part").agg(F.sum("_n").alias("_n"))
    points = Window.partitionBy(*keys, "_when")
    runs = store.written(runs.withColumns({"_before": F.sum("_n").over(points.orderBy("_part")) - F.col("_n"), "_total": F.sum("_n").over(points)}), "quantile-runs")
    wanted = runs.select("*", F.posexplode(F.array(*[F.lit(float(q)) for q in shares])).alias("_which", "_share")).withColumn("_at", F.col("_share") * (F.col("_total") - 1))
    wanted = wanted.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_at") + 1, F.ceil("_at") + 1)))).where((F.col("_place") > F.col("_before")) & (F.col("_place") <= F.col("_before") + F.col("_n")))
    wanted = store.written(wanted.select(*keys, "_part", "_when", "_which", "_at", "_place", (F.col("_place") - F.col("_before")).alias("_within")), "quantile-places")
    held = table.join(wanted.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi").select(*keys, "_part", "_value", "_since", "_n")
    schema = StructType([*wanted.schema.fields, StructField("_value", DoubleType())])
    found: dict[tuple, dict[int, float]] = {}
    for r in held.groupBy(*keys, "_part").cogroup(wanted.groupBy(*keys, "_part")).applyInArrow(_chosen, schema).collect():
        found.setdefault(((*[r[b] for b in by], r["_when"]), r["_column"], r["_which"], r["_at"]), {})[r["_place"]] = r["_value"]
    out: dict[tuple, dict[str, list[float]]] = {}
    for (group, column, which, at), ends in found.items():
        low, high = ends[int(at) + 1], ends[max(ends)]
        share = at - int(at)
        out.setdefault(group, {}).setdefault(column, [0.0] * len(shares))[which] = low if share == 0 else (1 - share) * low + share * high
    store.clear()
    return out


def quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()) -> dict[tuple, dict[str, list[float]]]:
    """Exact, interpolated quantiles of ``columns`` for each group ``by`` (one group, (), without).

    The driver receives two values a quantile, column and group. Nulls are left out; a column
    without values has no entry. A value that many rows share is one row with a count.
    """
    return {group[:-1]: found for group, found in _quantiles(rows, columns, shares, by, F.lit(0), 1).items()}


def history_quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float], period: str, points: Sequence[Any]) -> dict[Any, dict[str, list[float]]]:
    """For each of the sorted ``points``: quantiles of ``columns`` over the rows whose ``period`` is before it."""
    since = F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= F.col(period)))  # the first point that the row is before
    return {points[when]: found for (when,), found in _quantiles(rows, columns, shares, (), since, len(points)).items()}
