"""Places and quantiles where one value or tie is most of the rows."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrel.operators import forest, order, temporal
from sentrel.sources.scratch import Scratch


def test_a_value_of_most_rows_is_one_row(spark):
    """80 % of the rows share a value: counted, it moves as one row a group."""
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 < 4, 0.0).otherwise(F.rand(3)).alias("x"))
    moved = []
    dealt = order._dealt
    try:
        order._dealt = lambda rows, *a: moved.append(dealt(rows, *a)) or moved[-1]
        kept = Scratch.clear
        Scratch.clear = lambda *a: None
        found = order.quantiles(df, ["x"], (0.1, 0.5, 0.9, 1.0), ["g"])
    finally:
        order._dealt, Scratch.clear = dealt, kept
    sizes = [r[1] for r in moved[0].groupBy("_part").count().collect()]
    assert moved[0].where("_value = 0").count() == 3 and moved[0].count() == 3 + df.where("x > 0").count()
    assert max(sizes) <= 2 * statistics.median(sizes)
    for g in range(3):
        values = [r.x for r in df.where(F.col("g") == g).collect()]
        assert found[(g,)]["x"] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.9, 1.0]).tolist())


def test_ties_are_dealt_over_partitions(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 5 < 4, 0.0).otherwise(F.rand(3)).alias("x"), F.col("id").alias("own"))
    store = Scratch(spark)
    ranked = order.placed(df, [], [F.desc("x")], store, "rank")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 20_001))
    last = 2.0
    for r in ranked.orderBy("rank").collect():
        assert r.x <= last
        last = r.x
    sizes = [r[1] for r in store.tables[0][0].groupBy(F.shiftright("_at", order.WITHIN)).count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * statistics.median(sizes)


def test_history_quantiles_equal_those_of_the_rows_before(spark):
    r = random.Random(8)
    rows = [(r.choice(["2020-Q1", "2020-Q2", "2020-Q4", "2021-Q1"]), r.choice([0.0, 0.0, r.random(), None]), float(r.randint(0, 3)), None) for _ in range(500)]
    df = spark.createDataFrame(rows, "quarter string, x double, y double, never double").repartition(5)
    points = ["2020-Q2", "2020-Q3", "2020-Q4", "2021-Q1", "2021-Q2"]
    found = order.history_quantiles(df, ["x", "y", "never"], (0.25, 0.5, 0.75), "quarter", points)
    assert list(found) and set(found) == set(points)
    for at in points:
        for i, name in ((1, "x"), (2, "y")):
            values = [row[i] for row in rows if row[0] < at and row[i] is not None]
            assert found[at][name] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]).tolist())
        assert "never" not in found[at]
    assert order.history_quantiles(df, ["x"], (0.5,), "quarter", ["2020-Q1"]) == {}


def test_pools_of_a_large_history_are_the_smallest_hashes(spark, monkeypatch):
    """A pool is the same whether rows are left out early by their hash or all are ranked."""
    monkeypatch.setattr(forest, "POOL", 64)
    pairs = spark.range(900).select(F.concat(F.lit("D"), F.col("id") % 30).alias("drug"), F.concat(F.lit("E"), (F.col("id") / 30).cast("int")).alias("event"))
    rows = pairs.crossJoin(spark.createDataFrame([(f"2020-Q{i}",) for i in range(1, 5)], "quarter string"))
    rows = rows.select("*", *[F.rand(i).alias(x) for i, x in enumerate(temporal.FEATURES)]).persist()
    sizes = {f"2020-Q{i}": 900 * (i - 1) for i in range(2, 5)}
    fits = spark.createDataFrame([(at, *[[0.0, 0.0, 1.0]] * 6) for at in sizes], "at string, " + ", ".join(f"q_{x} array<double>" for x in temporal.FEATURES))
    pools = forest._pools(rows, fits, sizes, 42, Scratch(spark))
    for at in sizes:
        want = rows.where(F.col("quarter") < at).orderBy(forest.row_hash(42), "drug", "event", "quarter").limit(64).collect()
        got = pools.where(F.col("at") == at).orderBy("place").collect()
        assert [r.scaled_growth for r in got] == [round(r.growth, 9) for r in want]
