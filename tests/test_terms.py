"""Reports that hold their drugs, events and pairs as bits, against those that hold sets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sentrel.operators import adjusted, contingency, temporal
from sentrel.operators.contingency import Terms
from sentrel.plans import queries
from sentrel.plans.mapping import numbered, observations

SF = "/root/testdata/sf0.001"
SCHEMA = "report_id string, received_date date, drug string, event string, serious boolean, age_group string, sex string, year int, position int"


def sorted_rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module", params=[(64, 16), (20, 10), (3, 2)], ids=lambda p: f"{p[0]}x{p[1]}")
def both(request, spark):
    """The same rows with names and with numbers; up to 1,024 pairs and the last bit of a word, repeated and missing values."""
    n, m = request.param
    rng, drugs, events = random.Random(n), [f"D{i:02d}" for i in range(n)], [f"E{i:02d}" for i in range(m)]
    some = lambda values: rng.choice(values) if rng.random() < 0.95 else None
    rows = []
    for i in range(150):
        day = dt.date(2020 + rng.randrange(2), rng.choice([1, 2, 5, 12]), 3)
        for k in range(rng.randint(1, 6)):
            rows.append((some([f"r{i}"]), some([day]), some(drugs), some(events), some([True, False]), some(["a", "b"]), some(["f", "m"]), day.year, k))
    rows += [("last", dt.date(2020, 1, 1), drugs[-1], events[-1], True, "a", "f", 2020, 1), ("all", None, drugs[-1], events[0], None, None, None, None, 1)]
    named = spark.createDataFrame(rows, SCHEMA).persist()
    terms = Terms.of(named.select("drug"), named.select("event"))
    assert terms == Terms(tuple(drugs), tuple(events))
    return named, named.withColumns({"drug": contingency.number(F.col("drug"), drugs), "event": contingency.number(F.col("event"), events)}), terms


def test_cells_by_bits_are_those_by_sets(both):
    named, numbers, terms = both
    assert sorted_rows(contingency.contingency(numbers, terms=terms)) == sorted_rows(contingency.contingency(named)) != []
    assert sorted_rows(contingency.contingency(numbers, ["year"], dense=True, terms=terms)) == sorted_rows(contingency.contingency(named, ["year"], dense=True))


def test_features_by_bits_are_those_by_sets(both):
    named, numbers, terms = both
    assert sorted_rows(temporal.quarterly_features(numbers, terms)) == sorted_rows(temporal.quarterly_features(named)) != []


def test_profiles_by_bits_are_those_by_sets(both):
    named, numbers, terms = both
    sets, bits = adjusted.profiles(named), adjusted.profiles(numbers, terms)
    assert sorted_rows(adjusted.stratum_tables(bits, terms)) == sorted_rows(adjusted.stratum_tables(sets)) != []
    for pairs in ("report", "shown"):
        assert sorted_rows(contingency.tables(bits, pairs=pairs, terms=terms)) == sorted_rows(contingency.tables(sets, pairs=pairs))
    plain = lambda df: sorted_rows(df.select("report_id", F.array_sort("drugs").alias("drugs"), F.array_sort("events").alias("events"), "age_group", "sex", "year", "stratum"))
    assert plain(bits) == plain(sets)


def test_too_many_terms_stay_names(spark):
    few, many = spark.range(64).selectExpr("'x' || id"), spark.range(65).selectExpr("'x' || id")
    assert len(Terms.of(few, few.limit(16)).drugs) == 64
    assert Terms.of(many, few.limit(1)) is None and Terms.of(few, few.limit(17)) is None and Terms.of(few, few.limit(0)) is None
    assert numbered(spark, SF, "part")[1] is None
    with pytest.raises(Exception, match="not among the terms: z"):
        spark.sql("SELECT 'z' AS t").select(contingency.number(F.col("t"), ["a", "b"])).collect()


def test_queries_gather_no_sets_of_strings(spark, monkeypatch):
    """What the registered queries write as counts: rows are aggregated in place, by numbers alone."""
    plans = []
    monkeypatch.setattr(contingency, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    for name in ("quarter_features", "crude_ror", "stratum_tables", "signals_ranked"):
        queries.QUERIES[name](spark, SF)
    assert len(plans) == 4 and not [p for p in plans if "ObjectHashAggregate" in p or "collect_set" in p]
    obs, terms = numbered(spark, SF)
    assert obs.schema["drug"].dataType.typeName() == "integer" and len(terms.drugs) == 25
    assert sorted_rows(obs.groupBy("drug").count().select(F.get(F.array(*map(F.lit, terms.drugs)), "drug").alias("d"), "count")) == sorted_rows(observations(spark, SF).groupBy(F.col("drug").alias("d")).count())
