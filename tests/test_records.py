"""Validation, curation, references, cohorts, evidence, audit and sources."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sentrel.functions import normalize as nz
from sentrel.operators import audit, cohort, evidence, quality, reference
from sentrel.sources import pages, snapshots


def report(key, version=None, drug=None, reactions=("headache",), patient=True, **more):
    out = {"safetyreportid": key, "receivedate": "20250104", "serious": "1"} | ({"safetyreportversion": version} if version is not None else {})
    if patient:
        out["patient"] = {"patientonsetage": "40", "patientonsetageunit": "801", "patientsex": "2", "reaction": [{"reactionmeddrapt": r} for r in reactions], "drug": [drug or {"medicinalproduct": "x", "drugcharacterization": "1", "openfda": {"generic_name": [" aspirin "]}}]}
    return out | more


REPORTS = [report("100", "1"), report("100", "2", reactions=("headache", " nausea ")), report("200", "1", {"medicinalproduct": "  Drug   X ", "drugcharacterization": "9"}, ("rash",)), report("300", patient=False), report("400", drug={"drugcharacterization": "1"}), report("200", "1", {"medicinalproduct": "Drug X"}, ("rash",))]


def raw(spark, records):
    return spark.createDataFrame([("page-0", i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "page string, index long, payload string")


def test_reports_snapshot(spark):
    got = quality.processor("reports")(raw(spark, REPORTS), dt.date(2025, 1, 10))
    assert sorted(r.report_id for r in got["accepted"].collect()) == ["100", "200"]
    assert {r.report_id: r.reasons for r in got["rejected"].collect()} == {"300": ["patient: missing", "patient.drug: no entry", "patient.reaction: no entry or a blank one"], "400": [quality.NO_PAIR]}
    rows = {(r.drug_name, r.reaction): r for r in got["curated"].collect()}
    assert set(rows) == {("ASPIRIN", "HEADACHE"), ("ASPIRIN", "NAUSEA"), ("DRUG X", "RASH")}
    a = rows["ASPIRIN", "NAUSEA"]
    assert (a.version, a.drug_role, a.drug_name_source, a.patient_age_group, a.patient_sex, a.serious) == (2, "primary_suspect", "openfda_generic_name", "0-1", "female", True)
    m = got["metrics"].first()
    assert (m.input_records, m.valid_records, m.followups_removed, m.duplicates_removed, m.drug_name_fallbacks, m.age_days) == (6, 5, 1, 1, 1, 6)
    assert m.completeness["patient"] == 0.8333
    assert {r.name: r.status for r in got["checks"].collect()}["schema_validity_rate"] == "warn"


@pytest.mark.parametrize(
    ("record", "fine"),
    [
        (report("1"), True), (report("1", 2), True), (report("1", " 3 "), True), (report("1", True), True), (report("1", "2.0"), True), (report("1", 2.5), False), (report("1", "0"), False), (report("1") | {"safetyreportversion": None}, False), (report(" "), False), (report(7), False),
        (report("1", receivedate="20240230"), False), (report("1", receivedate="2024-01-01"), False), (report("1", reactions=()), False), (report("1", reactions=("a", " ")), False), ("not json", False), ("[1]", False), (report("1", extra={"a": 1}), True),
    ],
)
def test_report_contract(spark, record, fine):
    assert (quality.validate_reports(raw(spark, [record])).first().reasons == []) == fine


def sample(key, conc="10.5", updated="2025-01-02T00:00:00", **more):
    return {"record_id": key, "site": "s1", "state_territory": "ca", "source": "cdc", "sample_id": "p", "sample_collect_date": "2025-01-01", "pcr_target": " sars-cov-2", "date_updated": updated, "pcr_target_avg_conc": conc, "pcr_target_detect": "Yes"} | more


def test_samples_snapshot(spark):
    records = [sample("a"), sample("a", "12.5", "2025-02-02T00:00:00"), sample("b", None, pcr_target_detect="no"), sample("c", "-1"), {k: v for k, v in sample("x").items() if k != "record_id"}, sample("b", None, pcr_target_detect="no")]
    got = quality.processor("samples")(raw(spark, records), dt.date(2025, 3, 1))
    rows = {r.record_id: r for r in got["curated"].collect()}
    assert set(rows) == {"a", "b"} and rows["a"].concentration == 12.5 and rows["a"].state_territory == "CA" and rows["a"].pathogen == "SARS-COV-2" and rows["b"].target_detected is False
    m = got["metrics"].first()
    assert (m.rejected_records, m.valid_records, m.superseded_removed, m.duplicates_removed, m.missing_concentration) == (2, 4, 1, 1, 1)
    assert got["checks"].count() == 4
    with pytest.raises(ValueError):
        quality.processor("other")


def test_versions_in_any_order_and_empty_input(spark):
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate([2, 1, 2, 3, 3, None])], "key string, version int, at int")
    got = {r.at: (r.kind, r.winner) for r in quality.classified(df, "key", "version", ["at"]).collect()}
    assert got == {0: ("first", False), 1: ("followup", False), 2: ("duplicate", False), 3: ("followup", True), 4: ("duplicate", False), 5: ("followup", False)}
    out = quality.process_reports(raw(spark, REPORTS).where("false"), dt.date(2025, 1, 1))
    assert {r.name: r.status for r in out["checks"].collect()} == {"non_empty_input": "fail", "schema_validity_rate": "warn", "required_field_completeness": "warn", "curated_output": "fail", "snapshot_freshness": "observed"}


def test_normalisation(spark):
    row = spark.range(1).select(nz.normalize_term(F.lit("  a b\x1c\n c ")).alias("t"), nz.age_band(F.lit(1.9999)).alias("b"), nz.age_years(F.lit("2"), F.lit("805")).alias("y"), nz.age_years(F.lit("x"), F.lit("804")).alias("n"), nz.patient_sex(F.lit("")).alias("s"), nz.quarter_end(F.lit(dt.date(2024, 2, 1))).alias("q"), nz.brief_key(F.lit("a"), F.lit("b")).alias("k")).first()
    assert (row.t, row.b, row.y, row.n, row.s, row.q) == ("A B C", "0-1", 20.0, None, "unknown", dt.date(2024, 3, 31))
    assert row.k == hashlib.sha256(b"A\0B").hexdigest()[:20]


def test_benchmark_entries(spark):
    df = spark.createDataFrame(
        [("1", "2024-Q1", "seeded_unverified", "exact", ["A"], ["X"], None, None), ("2", "2024-Q1", "independently_reviewed", "unmatched", [], [], "me", "now"), ("3", "2025-Q1", "independently_reviewed", "exact", ["A"], ["X"], "me", "now"), ("4", "2024-Q2", "independently_reviewed", "manual", ["A"], ["X"], "me", None), ("4", "2024-Q2", "rejected", "manual", [], ["X"], None, None)],
        "reference_id string, publication_quarter string, review_status string, match_method string, normalized_drugs array<string>, normalized_events array<string>, reviewed_by string, reviewed_at string",
    )
    assert {r.reason: r.entries for r in reference.eligibility_counts(df, "2024-Q2").collect()} == {"not_independently_reviewed": 2, "unmatched_terminology": 1, "not_yet_published": 1, "eligible": 1}
    assert {(r.reference_id, r.problem) for r in reference.inconsistencies(df).collect()} == {("2", "reviewed without mapping"), ("4", "reviewed without reviewer or time"), ("4", "matched without mapping"), ("4", "repeated identifier")}


def test_cohort_rules(spark):
    d = dt.date
    df = spark.createDataFrame([("p", "new", d(2024, 7, 1), d(2024, 1, 1), d(2024, 12, 1), None, 40), ("p", "new", d(2024, 2, 1), d(2024, 1, 1), d(2024, 12, 1), d(2025, 1, 1), 131)], "person_id string, cohort string, exposure_start date, observation_start date, observation_end date, outcome_date date, age int")
    assert {r.violation for r in cohort.timeline_violations(df).collect()} == {"outcome outside follow-up", "age out of range"}
    assert {(r.violation, r.found) for r in cohort.set_violations(df).collect()} == {("repeated person", 1), ("not two cohorts", 1), ("short baseline", 1)}
    assert [r.violation for r in cohort.set_violations(df.where("false")).collect()] == ["empty cohort"]


def test_briefs_fail_closed(spark):
    docs = spark.createDataFrame([("d1", "Aspirin label", "headache reported"), ("d2", "Other", None), ("d0", "aspirin", "HEADACHE")], "document_id string, title string, content string")
    pairs = spark.createDataFrame([("ASPIRIN", "HEADACHE"), ("ZZZ", "QQQ")], "drug string, event string")
    found = evidence.retrieve(docs, pairs)
    assert [(r.document_id, r.relevance) for r in found.orderBy("rank").collect()] == [("d0", 1.0), ("d1", 1.0)]
    briefs = evidence.template_briefs(pairs, found)
    assert {r.drug: r.status for r in evidence.fail_closed(briefs).collect()} == {"ASPIRIN": "generated", "ZZZ": "abstained"}
    bad = briefs.withColumn("headline", F.lit("It CAUSES harm"))
    assert {r.drug: (r.status, r.claims) for r in evidence.fail_closed(bad).collect()}["ASPIRIN"] == ("abstained", [])
    unknown = briefs.where("status = 'generated'").withColumn("evidence_ids", F.array(F.lit("d0")))
    assert evidence.violations(unknown).first().errors == ["claim 1 cites unavailable evidence: d1"]
    with pytest.raises(ValueError):
        evidence.require_signals(pairs, pairs.limit(1))


def test_audit_chain(spark):
    df = spark.createDataFrame([("l", i, f"line{i}\n") for i in range(3)], "log string, at int, line string")
    rows = audit.chained(df, "log", ["at"], "line")
    assert [r.previous_digest for r in rows.orderBy("at").collect()] == [None, hashlib.sha256(b"line0\n").hexdigest(), hashlib.sha256(b"line0\nline1\n").hexdigest()]
    assert audit.broken_links(rows, "log", ["at"], "line").count() == 0
    changed = rows.withColumn("line", F.when(F.col("at") == 0, "other\n").otherwise(F.col("line")))
    assert audit.broken_links(changed, "log", ["at"], "line").count() == 2


def test_page_files_and_sets(spark, tmp_path):
    for i, records in enumerate([REPORTS[:2], REPORTS[2:3]]):
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"response": {"results": records}}))
    got = snapshots.raw_pages(spark, str(tmp_path))
    assert sorted((r["page"], r["index"]) for r in got.collect()) == [("page-0.json", 0), ("page-0.json", 1), ("page-1.json", 0)]
    assert quality.process_reports(got, dt.date(2025, 2, 1))["accepted"].count() == 2
    (tmp_path / "page-9.json").write_text('{"response": {}}')
    with pytest.raises(Exception, match="must be a list"):
        snapshots.raw_pages(spark, str(tmp_path)).collect()
    (tmp_path / "set.json").write_text(json.dumps({"reference_set_id": "s", "entries": [{"reference_id": "a"}, {"reference_id": "b"}]}))
    assert [(r.entry, r.reference_id) for r in snapshots.reference_entries(spark, str(tmp_path / "set.json")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "map.json").write_text('{"a": ["b", "c"]}')
    assert snapshots.comparators(spark, str(tmp_path / "map.json")).count() == 2


def test_paged_source_partitions():
    reader = pages.PageReader({"url": "http://x", "pageSize": "400", "maxRecords": "1000"})
    assert [(p.offset, p.limit) for p in reader.partitions()] == [(0, 400), (400, 400), (800, 200)]
    reader.fetch = lambda url: {"results": [{"a": 1}]} if "skip=400" in url else []
    assert list(reader.read(reader.partitions()[1])) == [("page-400", 0, '{"a": 1}')]
    with pytest.raises(ValueError):
        pages.PageReader({"url": "x", "pageSize": "2000", "maxRecords": "10"})
    assert (pages.delay(3, None, 1.0), pages.delay(1, "7", 1.0)) == (4.0, 7.0)


def test_stream_keeps_the_latest(spark, tmp_path):
    from sentrel.streaming import upsert

    (tmp_path / "in").mkdir()
    table = str(tmp_path / "out")
    for i, records in enumerate([REPORTS[:1], REPORTS[1:3], [report("200", "3")], REPORTS[:1]]):
        (tmp_path / "in" / f"page-{i}.json").write_text(json.dumps({"response": {"results": records}}))
        upsert.upsert_latest(upsert.stream_pages(spark, str(tmp_path / "in")), table, str(tmp_path / "check"), compact_every=3).awaitTermination()
        if i == 1:
            assert {(r.report_id, r.version) for r in upsert.current(spark, table).collect()} == {("100", 2), ("200", 1)}
    assert upsert._parts(spark, f"{table}/base") == [2] and upsert._parts(spark, f"{table}/delta") == [0, 1, 2, 3]
    (tmp_path / "out" / "delta" / "n=4").mkdir()  # a batch that was not finished
    assert {(r.report_id, r.version) for r in upsert.current(spark, table).collect()} == {("100", 2), ("200", 3)}
    assert {(r.report_id, r.version) for r in upsert.current(spark, table, upto=1).collect()} == {("100", 2), ("200", 1)}


def test_retrieval_is_the_same_for_few_and_many_words(spark, monkeypatch):
    """Whether documents are filtered by the pairs' words or dealt by word and block; a word may be in every document."""
    docs = spark.createDataFrame([(i, f"common title {i % 3}", f"common alpha{i % 4} beta{i % 5}") for i in range(60)], "document_id long, title string, content string")
    pairs = spark.createDataFrame([("common", "alpha1"), ("beta2", "alpha3"), ("none", "such"), ("common", "common")], "drug string, event string")
    few = sorted(evidence.retrieve(docs, pairs).collect())
    monkeypatch.setattr(evidence, "KNOWN_WORDS", 2)
    assert few == sorted(evidence.retrieve(docs, pairs).collect()) and len(few) == 15
    assert [(r.document_id, r.relevance) for r in few if r.event == "alpha1"] == [(i, 1.0) for i in (1, 5, 9, 13, 17)]


def test_rejected_records_have_the_digest_of_their_content(spark):
    """Spacing and order of keys do not matter; what is no JSON has the digest of its text."""
    texts = ['{"b": [1, 2.0],  "a": "é"}', '{"a":"\\u00e9","b":[1,2.0]}', "no JSON", None]
    rows = spark.createDataFrame([(t,) for t in texts], "payload string").select("payload", quality.payload_digest()).collect()
    want = hashlib.sha256(b'{"a":"\\u00e9","b":[1,2.0]}').hexdigest()
    assert [r.payload_sha256 for r in rows] == [want, want, hashlib.sha256(b"no JSON").hexdigest(), None]
    raw = spark.createDataFrame([("p", 0, '{"z": 1,\n "safetyreportid": "1"}')], "page string, index long, payload string")
    got = quality.process_reports(raw, dt.date(2025, 1, 1))["rejected"].first()
    assert got.payload_sha256 == hashlib.sha256(b'{"safetyreportid":"1","z":1}').hexdigest()


def test_conditions_do_not_repeat_the_parsing(spark):
    """Neither a condition on reasons nor an explode of them takes the checks down to where the records come from."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    told = quality.validate_reports(raw(spark, REPORTS))
    for rows in (told.where("size(reasons) = 0").select("index"), told.select("index", F.explode("reasons").alias("reason"))):
        assert plan(rows).count("parseJson") == 1
        assert not [line for line in plan(rows).splitlines() if "Filter" in line and "variant_get" in line]
    assert not [line for line in plan(quality.curate_reports(told)).splitlines() if "Filter" in line and "regexp_replace" in line]
    assert sorted((r["index"], r["reason"]) for r in told.select("index", F.explode("reasons").alias("reason")).collect()) == [(3, "patient.drug: no entry"), (3, "patient.reaction: no entry or a blank one"), (3, "patient: missing")]
