"""Report bitmaps against sets of reports, over several buckets."""

import random

from sentrel.operators import adjusted, bitmaps, contingency
from sentrel.sources.scratch import Scratch


def rows(n=3000):
    r = random.Random(3)
    return [(r.randint(0, n), f"D{min(r.randint(0, 9), r.randint(0, 9))}", f"E{r.randint(0, 4)}") for _ in range(3 * n)] + [(None, "D1", "E1"), (1, None, "E1"), (2, "D1", None)]


def test_cells_equal_those_of_sets(spark):
    obs = spark.createDataFrame(rows(), "report_id long, drug string, event string")
    stored = Scratch(spark).written(bitmaps.built(obs, Scratch(spark)), "bitmaps")
    want = {tuple(r) for r in contingency.contingency(obs).select("drug", "event", "a", "b", "c", "d", "n").collect()}
    assert {tuple(r) for r in bitmaps.cells(stored, obs.dropna()).select("drug", "event", "a", "b", "c", "d", "n").collect()} == want and len(want) == 50
    other = spark.createDataFrame([("D0", "E0"), ("D0", "none"), ("none", "E0")], "drug string, event string")
    got = {(r.drug, r.event): (r.a, r.b, r.c, r.n) for r in bitmaps.cells(stored, other).collect()}
    one = next(w for w in want if w[:2] == ("D0", "E0"))
    assert got == {("D0", "E0"): (one[2], one[3], one[4], one[6]), ("D0", "none"): (0, one[2] + one[3], 0, one[6]), ("none", "E0"): (0, 0, one[2] + one[4], one[6])}


def test_reports_beyond_one_bucket(spark):
    obs = spark.range(70_000).selectExpr("id * 3 AS report_id", "concat('D', id % 2) AS drug", "concat('E', id % 3) AS event")
    stored = Scratch(spark).written(bitmaps.built(obs, Scratch(spark)), "bitmaps")
    assert stored.where("kind = 'all'").count() == 3 and stored.count() == 3 * (1 + 2 + 3)
    assert {r.term: r.n for r in bitmaps.sizes(stored).where("kind = 'drug'").collect()} == {"D0": 35_000, "D1": 35_000}
    assert all(r.a in (11_666, 11_667) and r.n == 70_000 for r in bitmaps.cells(stored, obs).collect())


def test_arms_equal_those_of_reports(spark):
    obs = spark.createDataFrame([r for r in rows() if None not in r], "report_id long, drug string, event string")
    sets = spark.createDataFrame([("d1", "D2"), ("D1", "D3"), ("D4", "D4"), ("D5", "none"), ("none", "D1")], "drug string, comparator string")
    columns = ["drug", "event", "a", "b", "c", "d", "reports_used", "estimate"]
    want = sorted(tuple(r) for r in adjusted.active_comparator(contingency.gathered(obs), sets).select(*columns).collect())
    stored = Scratch(spark).written(bitmaps.built(obs, Scratch(spark)), "bitmaps")
    assert sorted(tuple(r) for r in bitmaps.active_comparator(stored, sets).select(*columns).collect()) == want and len(want) == 15


def test_no_rows(spark):
    none = spark.createDataFrame([], "report_id long, drug string, event string")
    stored = Scratch(spark).written(bitmaps.built(none, Scratch(spark)), "bitmaps")
    assert stored.count() == 0 and bitmaps.cells(stored, none.select("drug", "event")).count() == 0


def test_rare_terms_take_what_their_reports_take(spark):
    """Rare drugs list their reports; rare and frequent terms meet in one bucket."""
    obs = spark.range(6_000).selectExpr("id AS report_id", "concat('D', id % 1000) AS drug", "IF(id % 3 = 0, 'often', concat('E', id % 500)) AS event").union(spark.range(6_000).selectExpr("id", "'every'", "'often'"))
    stored = Scratch(spark).written(bitmaps.built(obs, Scratch(spark)), "bitmaps")
    assert {r.term for r in stored.where("bitmap is not null").collect()} == {"every", "often", ""}
    assert stored.where("bitmap is null and size(positions) <= 18 or positions is null").count() == stored.count()
    columns = ["drug", "event", "a", "b", "c", "d", "n"]
    want = sorted(tuple(r) for r in contingency.contingency(obs).select(*columns).collect())
    assert sorted(tuple(r) for r in bitmaps.cells(stored, obs).select(*columns).collect()) == want


def broadcast_rows(df):
    """Rows of every table that a run of ``df`` sends through the driver to all executors."""
    df.collect()
    found, ahead = [], [df._jdf.queryExecution().executedPlan()]
    while ahead:
        plan = ahead.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            found.append(plan.metrics().apply("numOutputRows").value())
        inner = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
        ahead += [plan.children().apply(i) for i in range(plan.children().size())] if inner is None else [inner]
    return found


def test_numbers_are_not_broadcast(spark):
    """Listed drugs meet frequent events: bitmaps, pairs and terms may pass through the driver, their reports may not."""
    obs = spark.range(40_000).selectExpr("id AS report_id", "concat('D', id % 100) AS drug", "concat('E', id % 2) AS event")
    stored = Scratch(spark).written(bitmaps.built(obs, Scratch(spark)), "bitmaps")
    assert stored.where("kind = 'drug' and bitmap is null").count() == 200
    found = broadcast_rows(bitmaps.cells(stored, obs))
    assert found and max(found) <= stored.count()


def test_arms_are_not_broadcast_as_numbers(spark):
    obs = spark.range(40_000).selectExpr("id AS report_id", "concat('D', id % 4) AS drug", "concat('E', id % 50) AS event")
    stored = Scratch(spark).written(bitmaps.built(obs, Scratch(spark)), "bitmaps")
    sets = spark.createDataFrame([("D0", "D1"), ("D2", "D3")], "drug string, comparator string")
    for answer in (bitmaps.arms(stored, sets), bitmaps.active_comparator(stored, sets)):
        found = broadcast_rows(answer)
        assert found and max(found) <= stored.count()
