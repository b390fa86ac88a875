"""Medians and MADs that are carried along, against those of each prefix."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrel.operators import temporal


@pytest.mark.parametrize("seed", range(4))
def test_median_and_mad_of_every_prefix(seed):
    r = random.Random(seed)
    history, values = temporal.History(), []
    for _ in range(300):
        x = float(r.choice([r.randint(0, 5), r.randint(-20, 20), r.random()]))
        history.add(x)
        values.append(x)
        middle = history.median()
        assert middle == np.median(values)
        assert history.mad(middle) == pytest.approx(np.median(np.abs(np.array(values) - middle)), abs=1e-12)


def test_long_histories_and_many_pairs(spark):
    """A pair of 10,000 periods beside short ones; scores equal those of plain prefixes."""
    long = spark.range(10_000).select(F.lit("A").alias("drug"), F.lit("X").alias("event"), F.format_string("%06d", "id").alias("quarter"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("report_count"))
    short = spark.range(200).select(F.concat(F.lit("B"), F.col("id") % 20).alias("drug"), F.lit(None).cast("string").alias("event"), F.format_string("%06d", "id").alias("quarter"), (F.col("id") * F.col("id")).alias("report_count"))
    rows = long.union(short).persist()
    began = time.perf_counter()
    got = {(r.drug, r.event, r.quarter): r for r in temporal.change_points(rows).collect()}
    assert len(got) == 10_200 and time.perf_counter() - began < 60
    past: dict = {}
    for r in rows.orderBy("drug", "event", "quarter").collect():
        before = past.setdefault((r.drug, r.event), [])
        if len(before) < 300:
            middle = np.median(before) if before else 0.0
            want = (r.report_count - middle) / max(1.4826 * np.median(np.abs(np.array(before) - middle)), 1.0) if len(before) >= 3 else 0.0
            one = got[r.drug, r.event, r.quarter]
            assert one.change_score == pytest.approx(want) and one.baseline_quarters == len(before)
        before.append(float(r.report_count))
