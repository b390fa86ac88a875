"""The jobs over a data folder, by way of the command line."""

import json

import pytest

from sentrel.__main__ import run
from sentrel.plans import jobs

from .test_records import REPORTS


def test_demo_backtest_and_brief(spark, tmp_path):
    root = str(tmp_path)
    rows = run(["demo", "--root", root], spark)["rows"]
    assert (rows["pairs"], rows["signals"], rows["features"], rows["adjusted"]) == (98, 8, 16, 4)
    store = jobs.Store(spark, root, "demo")
    top = store.read("analytics", "signals").where("drug = 'DRUG A' and event = 'EVENT X'").collect()
    ror, prr = (next(r for r in top if r.detector == d) for d in ("ror", "prr"))
    assert (ror.a, ror.b, ror.c, ror.d) == (26, 12, 12, 48)
    assert (ror.score, ror.lower_bound, ror.upper_bound) == pytest.approx((8.666667, 3.413678, 22.002989), abs=1e-5)
    assert (prr.score, prr.chi_square) == pytest.approx((3.421053, 22.977064), abs=1e-5)
    last = store.read("analytics", "temporal_signals").where("drug = 'DRUG A' and event = 'EVENT X' and quarter = '2025-Q4'").first()
    assert last.is_change_point and last.change_score == 10.0
    assert store.read("analytics", "forest").select("tree").distinct().count() == 200
    pair = store.read("analytics", "adjusted").where("drug = 'DRUG A' and event = 'EVENT X'").first()
    assert pair.crude_estimate == pytest.approx(8.666667, abs=1e-5) and pair.mantel_haenszel_estimate > 1 and pair.beta_binomial_lower > 1 and pair.active_comparator_estimate is None

    assert run(["export", "--root", root, "--snapshot", "demo", "--layer", "analytics", "--table", "strata"], spark)["rows"]["strata"] == store.read("analytics", "strata").count()
    for table in ("strata", "signals"):
        if table == "signals":
            run(["export", "--root", root, "--snapshot", "demo", "--layer", "analytics", "--table", table], spark)
        lines = [json.loads(x) for f in sorted((tmp_path / "export" / "reports" / "demo" / table).glob("part-*")) for x in f.read_text().splitlines()]
        assert all(list(x) == sorted(x) for x in lines)
        keys = [(x["drug"], x["event"], x["stratum"]) if table == "strata" else (not x["is_potential_signal"], not x["passes_stability_rule"], -x["score"], x["detector"], x["drug"], x["event"]) for x in lines]
        assert keys == sorted(keys) and keys

    (tmp_path / "set.json").write_text(json.dumps({"reference_set_id": "s", "entries": [{"reference_id": "a", "signal_quarter": "2025-Q4", "normalized_drug": "DRUG A", "normalized_event": "EVENT X", "match_method": "exact"}]}))
    rows = run(["backtest", "--root", root, "--snapshot", "demo", "--reference-set", str(tmp_path / "set.json"), "--k", "1"], spark)["rows"]
    assert rows["quarter_metrics"] == 16 and rows["detector_summary"] == 4

    (tmp_path / "evidence.json").write_text(json.dumps([{"document_id": "d", "title": "Drug A", "content": "event x was reported"}]))
    args = ["brief", "--root", root, "--snapshot", "demo", "--evidence-set", str(tmp_path / "evidence.json"), "--drug"]
    with pytest.raises(ValueError):
        run([*args, "DRUG C", "--event", "EVENT X"], spark)
    assert run([*args, "drug a", "--event", "event x"], spark)["rows"] == {"briefs": 1}
    assert store.read("analytics", "briefs").first().status == "generated"
    with pytest.raises(Exception, match="(?i)exists"):
        run(["score", "--root", root, "--snapshot", "demo"], spark)


def test_process_then_score_and_adjust(spark, tmp_path):
    raw = tmp_path / "raw" / "reports" / "first"
    raw.mkdir(parents=True)
    (raw / "page-0.json").write_text(json.dumps({"response": {"results": REPORTS}}))
    (tmp_path / "sets.json").write_text('{"Aspirin": ["Drug X"]}')
    at = ["--root", str(tmp_path), "--snapshot", "first"]
    rows = run(["process", *at, "--as-of", "2025-02-01"], spark)["rows"]
    assert (rows["accepted"], rows["rejected"], rows["pairs"], rows["checks"]) == (2, 2, 3, 5)
    assert run(["score", *at, "--require-checks"], spark)["rows"] == {"signals": 6}
    assert run(["adjust", *at, "--comparator-set", str(tmp_path / "sets.json")], spark)["rows"]["adjusted"] == 3
    got = {r.drug: r.active_comparator_estimate for r in jobs.Store(spark, str(tmp_path), "first").read("analytics", "adjusted").collect()}
    assert got["ASPIRIN"] is not None and got["DRUG X"] is None


def test_references_and_identifiers(spark, tmp_path):
    entry = {"reference_id": "a", "publication_quarter": "2024-Q1", "review_status": "seeded_unverified", "match_method": "exact", "normalized_drugs": ["A"], "normalized_events": ["X"], "reviewed_by": None, "reviewed_at": None}
    (tmp_path / "ok.json").write_text(json.dumps({"reference_set_id": "s", "entries": [entry, entry | {"reference_id": "b", "review_status": "independently_reviewed", "reviewed_by": "me", "reviewed_at": "now"}]}))
    assert run(["check-references", "--reference-set", str(tmp_path / "ok.json"), "--quarter", "2024-Q2"], spark)["rows"] == {"not_independently_reviewed": 1, "eligible": 1}
    (tmp_path / "bad.json").write_text(json.dumps({"reference_set_id": "s", "entries": [entry | {"normalized_drugs": []}, entry | {"reviewed_by": "me", "reviewed_at": "now"}]}))
    with pytest.raises(ValueError, match="repeated identifier|matched without"):
        run(["check-references", "--reference-set", str(tmp_path / "bad.json"), "--quarter", "2024-Q2"], spark)
    with pytest.raises(ValueError):
        run(["score", "--root", str(tmp_path), "--snapshot", "../up"], spark)
