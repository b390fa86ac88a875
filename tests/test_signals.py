"""Contingency tables, detectors and temporal operators on small inputs with known answers."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sentrel.operators import adjusted, backtest, contingency, detectors, forest, serve, temporal
from sentrel.plans import queries


def rows_of(counts, day="2025-01-04"):
    out = []
    for (drug, event), n in counts.items():
        out += [(f"{drug}{event}{i}", dt.date.fromisoformat(day), drug, event) for i in range(n)]
    return out


OBS = "report_id string, received_date date, drug string, event string"


@pytest.fixture(scope="module")
def twenty(spark):
    return spark.createDataFrame(rows_of({("A", "X"): 5, ("A", "Y"): 1, ("B", "X"): 1, ("B", "Y"): 13}), OBS)


def test_scores_of_twenty_reports(twenty):
    scores = detectors.score(contingency.contingency(twenty))
    got = {(r.detector, r.drug, r.event): r for r in scores.collect()}
    r = got["ror", "A", "X"]
    assert (r.a, r.b, r.c, r.d) == (5, 1, 1, 13)
    assert (r.score, r.lower_bound, r.upper_bound) == pytest.approx((65.0, 3.376534, 1251.283004), abs=1e-5)
    p = got["prr", "B", "Y"]
    assert (p.score, p.lower_bound, p.upper_bound, p.chi_square) == pytest.approx((5.571429, 0.92546, 33.54096, 11.609977), abs=1e-5)
    assert p.is_potential_signal and not p.passes_stability_rule
    totals = detectors.totals(scores).first()
    assert (totals.scores, totals.pairs, totals.potential_signals, totals.stable_signals) == (8, 4, 4, 3)
    assert [r.drug for r in serve.answers("signals", scores, 2, potential=True).collect()] == ["A", "B"]


@pytest.mark.parametrize(
    ("cells", "ror", "prr"),
    [((10, 90, 20, 880), (4.888889, 2.219935, 10.766637), None), ((0, 10, 2, 100), (1.914286, 0.086044, 42.588777), None), ((1, 0, 0, 10), None, (16.5, 0.979701, 277.890833, 11.0))],
)
def test_single_tables(spark, cells, ror, prr):
    df = spark.createDataFrame([("D", "E", *cells)], "drug string, event string, a long, b long, c long, d long")
    if ror:
        r = detectors.reporting_odds_ratio(df).first()
        assert (r.score, r.lower_bound, r.upper_bound) == pytest.approx(ror, abs=1e-5)
    if prr:
        r = detectors.proportional_reporting_ratio(df).first()
        assert (r.score, r.lower_bound, r.upper_bound, r.chi_square) == pytest.approx(prr, abs=1e-4)
        assert not r.is_potential_signal


def test_negative_cells_and_large_counts(spark):
    schema = "drug string, event string, a long, b long, c long, d long"
    with pytest.raises(Exception, match="non-negative"):
        detectors.reporting_odds_ratio(spark.createDataFrame([("D", "E", -1, 1, 1, 1)], schema)).collect()
    big = 4_000_000_000
    assert detectors.proportional_reporting_ratio(spark.createDataFrame([("D", "E", big, big, big, big * 2)], schema)).first().chi_square > 0


def test_cells_equal_sets_of_reports(spark):
    rng = random.Random(2)
    rows = [(f"r{rng.randint(0, 30)}", rng.choice("ABC"), rng.choice("XYZ"), rng.choice(["q1", "q2"])) for _ in range(150)]
    df = spark.createDataFrame([*rows, (None, "A", "X", "q1"), ("r1", None, "X", "q1")], "report_id string, drug string, event string, quarter string")
    got = {(r.quarter, r.drug, r.event): (r.a, r.b, r.c, r.d) for r in contingency.contingency(df, by=["quarter"], dense=True).collect()}
    for q, drug, event in itertools.product(["q1", "q2"], "ABC", "XYZ"):
        here = [r for r in rows if r[3] == q]
        all_, d, e = {r[0] for r in here}, {r[0] for r in here if r[1] == drug}, {r[0] for r in here if r[2] == event}
        assert got[q, drug, event] == (len(d & e), len(d - e), len(e - d), len(all_ - d - e))
    assert contingency.contingency(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def quarters(spark):
    rows = []
    for q, n in enumerate([2, 2, 2, 20]):
        day = f"2024-{q * 3 + 2:02d}-10"
        rows += [(f"{q}-{r[0]}", *r[1:], i % 2 == 0) for i, r in enumerate(rows_of({("DRUG A", "EVENT X"): n, ("DRUG B", "EVENT Y"): 10}, day))]
    return spark.createDataFrame(rows, OBS + ", serious boolean")


def test_quarterly_features_and_changes(quarters):
    features = temporal.quarterly_features(quarters)
    a = {r.quarter: r for r in features.where("drug = 'DRUG A'").collect()}
    assert a["2024-Q1"].ror == pytest.approx(105.0) and a["2024-Q4"].prr == pytest.approx(21.47619, abs=1e-5)
    assert [a[f"2024-Q{i}"].growth for i in range(1, 5)] == [2, 0, 0, 9]
    assert a["2024-Q4"].quarter_end == dt.date(2024, 12, 31) and a["2024-Q4"].serious_proportion == 0.5
    change = temporal.change_points(features).where("is_change_point").collect()
    assert [(r.drug, r.quarter, r.change_score, r.baseline_quarters) for r in change] == [("DRUG A", "2024-Q4", 18.0, 3)]


def test_forest_finds_the_spike_and_repeats(quarters):
    features = temporal.quarterly_features(quarters)
    one = forest.isolation_forest(features, contamination=0.125).collect()
    two = forest.isolation_forest(features.repartition(5), contamination=0.125).collect()
    key = lambda r: (r.drug, r.quarter)
    assert sorted(one, key=key) == sorted(two, key=key)
    assert max(one, key=lambda r: r.anomaly_score).quarter == "2024-Q4"
    assert sum(r.is_anomaly for r in one) == 1


def test_walk_forward_sees_only_the_past(quarters):
    features = temporal.quarterly_features(quarters)
    changed = features.withColumn("report_count", F.when(F.col("quarter") == "2024-Q4", 999).otherwise(F.col("report_count")))
    q3 = lambda df: sorted(forest.walk_forward(df, minimum_rows=4, trees=20).where("quarter = '2024-Q3'").collect())
    assert q3(features) == q3(changed) != []
    assert forest.walk_forward(features, minimum_rows=8, trees=5).where("quarter < '2024-Q4'").count() == 0


def test_walk_forward_equals_one_forest_a_quarter(quarters):
    features = temporal.quarterly_features(quarters).persist()
    got = {(r.quarter, r.drug, r.event): r.score for r in forest.walk_forward(features, minimum_rows=4, trees=7).collect()}
    want = {}
    for quarter in ["2024-Q2", "2024-Q3", "2024-Q4"]:
        past, now = features.where(F.col("quarter") < quarter), features.where(F.col("quarter") == quarter)
        if past.count() >= 4:
            for r in forest.scores(temporal.robust_scale(now, fitted_on=past), forest.grow(temporal.robust_scale(past), 7)).collect():
                want[r.quarter, r.drug, r.event] = r.isolation - forest.OFFSET
    assert got == pytest.approx(want, abs=1e-12) and got


def test_registered_walk_forward_scores_every_quarter(spark):
    """All quarters but those with fewer than eight earlier rows, by the default trees."""
    sf = "/root/testdata/sf0.001"
    rows = queries.quarter_features(spark, sf).groupBy("quarter").count().collect()
    n = {r[0]: r[1] for r in rows}
    want = {q: n[q] for q in n if sum(n[p] for p in n if p < q) >= forest.MINIMUM_TRAINING_ROWS}
    found = queries.walk_forward_forest(spark, sf)
    assert {r[0]: r[1] for r in found.groupBy("quarter").count().collect()} == want
    assert max(want) > "2001" and len(want) > 20


def test_backtest_counts_references_and_nulls(spark, quarters):
    features = temporal.quarterly_features(quarters)
    refs = spark.createDataFrame(
        [(0, "a", "2024-Q4", "DRUG A", "EVENT X", "exact"), (1, "b", "2024-Q4", "DRUG A", "EVENT X", "manual"), (2, "c", "2030-Q1", "DRUG A", "EVENT X", "exact"), (3, "d", "2024-Q4", None, None, "unmatched")],
        "entry int, reference_id string, signal_quarter string, drug string, event string, match_method string",
    )
    scores, known = backtest.detector_scores(features), backtest.in_window(refs, features)
    m = {(r.quarter, r.detector): r for r in backtest.quarter_metrics(features, scores, known, 1, [*backtest.STATISTICS, "isolation_forest"]).collect()}
    last = m["2024-Q4", "report_count"]
    assert (last.hits, last.alerts, last.recall_at_k, last.precision_at_k) == (2, 1, 1.0, 2.0)
    assert m["2024-Q1", "ror"].recall_at_k is None and not m["2024-Q1", "isolation_forest"].available
    ranks = backtest.rankings(scores, known).where("quarter = '2024-Q4' and detector = 'report_count' and rank = 1").first()
    assert ranks.matched_reference_ids == ["a", "b"]
    s = {r.detector: r for r in backtest.detector_summary(features, scores, known, 1, ["report_count", "isolation_forest"]).collect()}
    assert s["report_count"].median_lead_quarters == 0 and s["isolation_forest"].precision_at_k is None
    assert {(r.match_method, r.entries, r.out_of_window) for r in backtest.coverage(refs, features).collect()} == {("exact", 2, 1), ("manual", 1, 0), ("unmatched", 1, 0)}


@pytest.fixture(scope="module")
def strata(spark):
    rows, n = [], 0
    for age, sex in (("18-44", "female"), ("45-64", "male"), ("65+", "female")):
        for (drug, event), k in {("a", "x"): 8, ("a", "y"): 4, ("b", "x"): 3, ("b", "y"): 10}.items():
            rows += [(f"r{(n := n + 1)}", drug, event, age, sex, 2025, 1) for _ in range(k)]
    return adjusted.profiles(spark.createDataFrame(rows, "report_id string, drug string, event string, age_group string, sex string, year int, position int"))


def first(df):
    return df.where("drug = 'A' and event = 'X'").first()


def test_adjusted_estimates(spark, strata):
    cells = contingency.tables(strata, pairs="report")
    want = (6.666667, 2.410231, 18.439914)
    crude = first(adjusted.crude(cells))
    assert (crude.ror, crude.lower_bound, crude.upper_bound) == pytest.approx(want, abs=1e-5)
    tables = adjusted.stratum_tables(strata)
    mh = first(adjusted.mantel_haenszel(tables))
    assert (mh.estimate, mh.lower_bound, mh.upper_bound) == pytest.approx(want, abs=1e-5)
    assert first(adjusted.stratum_estimates(tables)).prr == pytest.approx(2.888889, abs=1e-5)
    het = first(adjusted.heterogeneity_p(adjusted.heterogeneity(adjusted.stratum_estimates(tables))))
    assert het.q == pytest.approx(0, abs=1e-9) and het.df == 2 and het.p == pytest.approx(0.996, abs=1e-3)
    logistic = first(adjusted.penalized_logistic(strata))
    assert logistic.estimate == pytest.approx(4.361417, abs=1e-4) and logistic.reports_used == 75
    bayes = first(adjusted.beta_binomial(cells))
    assert (bayes.estimate, bayes.lower_bound, bayes.upper_bound) == pytest.approx((4.126643, 1.804913, 9.987456), abs=1e-4)
    active = first(adjusted.active_comparator(strata, spark.createDataFrame([("a", "b")], "drug string, comparator string")))
    assert active.estimate == pytest.approx(want[0], abs=1e-5) and active.reports_used == 75


def test_small_strata_are_left_out(spark):
    rows = [(f"r{i}", "a", "x", "18-44", "male", 2020, 1) for i in range(3)]
    df = adjusted.profiles(spark.createDataFrame(rows, "report_id string, drug string, event string, age_group string, sex string, year int, position int"))
    assert adjusted.stratum_tables(df).count() == 0


def test_limits_and_identifiers(twenty):
    with pytest.raises(ValueError):
        serve.answers("signals", detectors.score(contingency.contingency(twenty)), limit=0)
    with pytest.raises(ValueError):
        serve.safe_identifier("../up")
    assert serve.safe_identifier("demo-2024") == "demo-2024"


def test_temporal_anomalies_are_those_of_the_forest(spark):
    """The query against plain filtering of the forest's rows."""
    sf = "/root/testdata/sf0.001"
    found = [(r.quarter, r.event, r.anomaly_score) for r in queries.temporal_anomalies(spark, sf).collect()]
    scored = queries.isolation_forest(spark, sf).where("drug = 'BRAND#11' and is_anomaly").collect()
    assert found == sorted((r.quarter, r.event, r.anomaly_score) for r in scored)[:50] and found
    with pytest.raises(ValueError):
        serve.answers("temporal", spark.range(1), 0)


def test_reports_are_read_once_and_the_grid_is_not_sorted(spark, quarters):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan(contingency.contingency(quarters)) + plan(temporal.quarterly_features(quarters))
    assert "Window" not in plan(temporal.quarterly_features(quarters))


def test_shown_and_marked_pairs_of_mixed_reports(spark):
    """A report whose rows show some of its pairs, and mark some of these."""
    rows = [("r1", "A", "X", "q", True), ("r1", "B", "Y", "q", False), ("r2", "A", "X", "q", False), ("r2", "A", "Y", "q", True), ("r3", "B", "X", "q", True)]
    df = spark.createDataFrame(rows, "report_id string, drug string, event string, quarter string, serious boolean")
    cells = contingency.tables(contingency.gathered(df, ["quarter"], F.col("serious")), ["quarter"])
    assert {(r.drug, r.event): (r.a, r.b, r.c, r.d, r.marked) for r in cells.collect()} == {("A", "X"): (2, 0, 1, 0, 1), ("A", "Y"): (2, 0, 0, 1, 1), ("B", "X"): (2, 0, 1, 0, 1), ("B", "Y"): (1, 1, 1, 0, 0)}


def test_reports_gather_one_set(spark):
    """What a report shows, marked or not, is read off one set; each further set costs a pass of sorting as well."""
    rows = [("r1", "A", "X", True), ("r1", "A", "X", False), ("r1", "B", "X", None), ("r1", "A", "Y", False), ("r2", "A", "X", True), ("r2", "B", "Y", True), ("r3", "A", "X", None), ("r4", None, "X", True)]
    df = spark.createDataFrame(rows, "report_id string, drug string, event string, serious boolean")
    reports = contingency.gathered(df, marked=F.col("serious"))
    for gathered in (reports, contingency.gathered(df), adjusted.profiles(df.withColumns({"position": F.lit(1), "age_group": F.lit("a"), "sex": F.lit("s"), "year": F.lit(2000)}))):
        plan = gathered._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_set(") == 1
    got = {r.report_id: [sorted(map(tuple, x)) for x in (r.shown, r.marked)] + [sorted(r.drugs), sorted(r.events)] for r in reports.collect()}
    assert got == {
        "r1": [[("A", "X"), ("A", "Y"), ("B", "X")], [("A", "X")], ["A", "B"], ["X", "Y"]],
        "r2": [[("A", "X"), ("B", "Y")], [("A", "X"), ("B", "Y")], ["A", "B"], ["X", "Y"]],
        "r3": [[("A", "X")], [], ["A"], ["X"]],
    }
    counted = {(r.drug, r.event): (r.k, r.shown, r.marked) for r in contingency.counts(reports).collect()}
    assert counted["A", "X"] == (3, 3, 2) and counted["B", "Y"] == (2, 1, 1) and counted["A", "Y"] == (2, 1, 0) and counted[None, None][0] == 3
    assert "shown" not in contingency.counts(contingency.gathered(df), shown=False).columns
