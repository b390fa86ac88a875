"""Manifests, paged ingestion against a local server, the review log, and places of sorted groups."""

import hashlib
import json
import random
import statistics
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from sentrel.operators import audit, order
from sentrel.sources import ingest, manifests, pages
from sentrel.sources.scratch import Scratch

GIVEN = {"manifest_version": 1, "snapshot_id": "demo-1", "search": "x:1", "page_size": 3, "max_records": 10}
TABLE = {"manifest_version": 1, "source": "lake", "snapshot_id": "demo-2", "domain": "data.example.gov", "dataset_id": "ab12-cd34", "page_size": 4, "max_records": 100}


def test_manifests_are_checked():
    m = manifests.manifest("openfda", GIVEN)
    assert m.digest == hashlib.sha256(json.dumps(GIVEN, sort_keys=True, separators=(",", ":")).encode()).hexdigest() and m.source == "openfda"
    assert manifests.manifest("socrata", TABLE)["order"] == ":id"
    for kind, base, change, word in [
        ("openfda", GIVEN, {"page_size": 1001}, "page_size"), ("openfda", GIVEN, {"max_records": 25_001}, "max_records"), ("openfda", GIVEN, {"search": " "}, "search"), ("openfda", GIVEN, {"snapshot_id": "../up"}, "snapshot_id"), ("openfda", GIVEN, {"more": 1}, "more: unknown"),
        ("openfda", GIVEN, {"manifest_version": 2}, "manifest_version"), ("openfda", GIVEN, {"page_size": True}, "page_size"), ("socrata", TABLE, {"domain": "no host"}, "domain"), ("socrata", TABLE, {"dataset_id": "x"}, "dataset_id"), ("socrata", TABLE, {"page_size": 50_001}, "page_size"), ("socrata", TABLE, {"order": ""}, "order"),
    ]:
        with pytest.raises(ValueError, match=word):
            manifests.manifest(kind, base | change)
    with pytest.raises(ValueError, match="search: missing"):
        manifests.manifest("openfda", {k: v for k, v in GIVEN.items() if k != "search"})


def test_quarterly_archives():
    url = f"https://{manifests.ARCHIVE_HOST}/content/a.zip"
    given = {"archives": [{"quarter": q, "url": url} for q in ("2024Q2", "2024Q1", "2025Q4")]}
    assert [a["quarter"] for a in manifests.archives(given)] == ["2024Q2", "2024Q1", "2025Q4"]
    assert [a["quarter"] for a in manifests.archives(given, {"2025Q4", "2024Q2"})] == ["2024Q2", "2025Q4"]
    for bad in ({"quarter": "2024Q5", "url": url}, {"quarter": "2024Q1", "url": url}, {"quarter": "2020Q1", "url": "http://fis.fda.gov/a.zip"}, {"quarter": "2020Q1", "url": "https://other.gov/a.zip"}, {"quarter": "2020Q1", "url": url[:-3] + "txt"}):
        with pytest.raises(ValueError):
            manifests.archives({"archives": [*given["archives"], bad]})
    with pytest.raises(ValueError, match="2019Q1"):
        manifests.archives(given, ["2019Q1"])


@pytest.fixture()
def server():
    class Handler(BaseHTTPRequestHandler):
        records = [{"id": f"r{i}", "n": str(i)} for i in range(8)]
        asked: list = []
        failures = 1

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            if Handler.failures:
                Handler.failures -= 1
                self.send_response(503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            Handler.asked.append(q)
            at, n = int(q.get("skip", q.get("$offset", 0))), int(q.get("limit", q.get("$limit", 0)))
            rows = Handler.records[at : at + n]
            body = json.dumps({"results": rows} if "skip" in q else rows).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    own = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield Handler, f"http://127.0.0.1:{own.server_port}/x.json"
    own.shutdown()


def test_reruns_fetch_what_is_missing(spark, tmp_path, server):
    handler, url = server
    m = manifests.manifest("openfda", GIVEN)
    root = str(tmp_path)
    assert ingest.ingest(spark, root, m, url, backoff="0") == {"fetched_pages": 3, "reused_pages": 0, "total_records": 8}
    assert {q["search"] for q in handler.asked} == {"x:1"}
    before = len(handler.asked)
    assert ingest.ingest(spark, root, m, url) == {"fetched_pages": 0, "reused_pages": 3, "total_records": 8}
    assert len(handler.asked) == before  # a rerun of a whole snapshot asks for nothing
    path = f"{root}/raw/openfda/demo-1/pages"
    stored = ingest.stored_pages(spark, path)
    assert [(r["page"], r["index"], json.loads(r.payload)["id"]) for r in ingest.raw_records(stored).orderBy("page", "index").collect()] == [(f"page-{i // 3 * 3:09d}", i % 3, f"r{i}") for i in range(8)]
    with pytest.raises(ValueError, match="another manifest"):
        ingest.ingest(spark, root, manifests.manifest("openfda", GIVEN | {"search": "y"}), url)
    # a page that lost its digest is fetched anew and refused, as its records were others
    broken = [r.asDict() for r in stored.collect()]
    broken[0]["payloads"] = ["{}"]
    broken[0]["sha256"] = "0" * 64
    spark.createDataFrame(broken, ingest.PAGES).write.parquet(f"{root}/raw/openfda/demo-9/pages")
    other = manifests.Manifest("openfda", m.values | {"snapshot_id": "demo-9"})
    spark.createDataFrame(broken, ingest.PAGES).withColumn("manifest_digest", F.lit(other.digest)).write.mode("overwrite").parquet(f"{root}/raw/openfda/demo-9/pages")
    with pytest.raises(FileExistsError):
        ingest.ingest(spark, root, other, url)


def test_second_interface_and_an_empty_source(spark, tmp_path, server):
    handler, url = server
    m = manifests.manifest("socrata", TABLE | {"where": "n > '1'"})
    assert ingest.ingest(spark, str(tmp_path), m, url, backoff="0")["total_records"] == 8
    assert handler.asked[0]["$where"] == "n > '1'" and handler.asked[0]["$order"] == ":id"
    handler.records = []
    none = manifests.manifest("socrata", TABLE | {"snapshot_id": "none"})
    assert ingest.ingest(spark, str(tmp_path), none, url) == {"fetched_pages": 1, "reused_pages": 0, "total_records": 0}


def test_missing_pages_end_at_a_short_one(spark):
    m = manifests.manifest("openfda", GIVEN | {"max_records": 30})
    done = spark.createDataFrame([(0, 3), (6, 1)], "skip long, records long")
    assert [r.skip for r in ingest.missing(ingest.planned(spark, m), done).collect()] == [3]
    assert [(r.skip, r.limit) for r in ingest.planned(spark, manifests.manifest("openfda", GIVEN)).collect()] == [(0, 3), (3, 3), (6, 3), (9, 1)]


def test_filters_become_conditions(spark, server):
    handler, url = server
    reader = pages.FilteringPageReader({"interface": "socrata", "pageSize": "10", "maxRecords": "10", "columns": "id, n", "url": url, "param.$where": "a = 1", "backoff": "0"})
    rest = list(reader.pushFilters([EqualTo(("id",), "it's"), GreaterThan(("n",), "3"), EqualTo(("payload",), "x"), EqualTo(("n",), 3)]))
    assert len(rest) == 2 and reader.conditions == ["id = 'it''s'", "n > '3'"]
    assert [r[3:] for r in reader.read(reader.partitions()[0])][:2] == [("r0", "0"), ("r1", "1")]
    assert handler.asked[0]["$where"] == "(a = 1) AND id = 'it''s' AND n > '3'"
    assert list(pages.FilteringPageReader({"pageSize": "10", "maxRecords": "10"}).pushFilters([EqualTo(("id",), "x")]))
    with pytest.raises(ValueError):
        pages.PageReader({"interface": "openfda", "pageSize": "1001", "maxRecords": "10"})
    assert (pages.delay(3, None, 1.0), pages.delay(1, "7", 1.0)) == (4.0, 7.0)


def test_conditions_reach_the_interface(spark, server):
    handler, url = server
    spark.dataSource.register(pages.PagedRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("paged_records").options(url=url, interface="socrata", pageSize="10", maxRecords="10", columns="id,n", pushdown="true", backoff="0").load()
        assert [r.id for r in df.where("n = '3'").collect()] in (["r3"], [f"r{i}" for i in range(8)])  # this server filters nothing
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert "n = '3'" in handler.asked[-1]["$where"]


def test_reviews_are_appended_to_the_chain(spark):
    new = "occurred_at string, actor string, role string, source string, snapshot_id string, drug string, event string, decision string, rationale string"
    none = spark.createDataFrame([], new + ", action string, event_id string, sequence int, line string, previous_digest string")
    one = audit.appended(none, spark.createDataFrame([("2025-01-02", "ann", "admin", "reports", "s1", "a", "x", "accept", "seen"), ("2025-01-01", "bob", "reviewer", "reports", "s1", "a", "x", "reject", "né")], new)).persist()
    assert [(r.sequence, r.actor, r.drug, r.previous_digest is None) for r in one.orderBy("sequence").collect()] == [(1, "bob", "A", True), (2, "ann", "A", False)]
    log = one.unionByName(audit.appended(one, spark.createDataFrame([("2025-01-03", "cy", "reviewer", "reports", "s1", "b", "y", "needs_more_evidence", "?")], new)))
    rows = log.orderBy("sequence").collect()
    assert [r.previous_digest for r in rows] == [None, *[hashlib.sha256("".join(x.line for x in rows[: i + 1]).encode()).hexdigest() for i in range(2)]]
    assert len({r.event_id for r in rows}) == 3 and all(len(r.event_id) == 24 for r in rows)
    fields = {"action", "actor", "decision", "drug", "event", "event_id", "occurred_at", "previous_digest", "rationale", "role", "snapshot_id", "source"}
    for r in rows:
        event = json.loads(r.line)
        assert set(event) == fields and all(event[c] == r[c] for c in fields) and event["action"] == "signal_reviewed"
        assert r.line == json.dumps(event, sort_keys=True, separators=(",", ":")) + "\n"
    assert audit.broken_links(log.withColumn("log", F.lit("l")), "log", ["sequence"], "line").count() == 0
    for bad in (("2025", "a", "admin", "s", "s", "d", "e", "maybe", "r"), ("2025", " ", "admin", "s", "s", "d", "e", "accept", "r"), ("2025", "a", "admin", "s", "s", "d", "e", "accept", None), ("2025", "a", "other", "s", "s", "d", "e", "accept", "r")):
        with pytest.raises(ValueError):
            audit.appended(none, spark.createDataFrame([bad], new))


def test_places_and_quantiles_across_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abbbbb"), rng.choice([rng.random(), 0.5]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x double, i int").repartition(7)
    got = {(r.g, r.i): r.place for r in order.placed(df, ["g"], [F.desc("x"), "i"], Scratch(spark)).collect()}
    for g in "ab":
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[g, r[2]] for r in want] == list(range(1, len(want) + 1))
    found = order.quantiles(df.withColumn("y", F.when(F.col("i") > 10, F.col("i").cast("double"))), ["x", "y"], (0.0, 0.25, 0.5, 0.95, 1.0), ["g"])
    for g in "ab":
        for name, values in (("x", [r[1] for r in rows if r[0] == g]), ("y", [float(r[2]) for r in rows if r[0] == g and r[2] > 10])):
            cuts = statistics.quantiles(values, n=20, method="inclusive")
            assert found[(g,)][name] == pytest.approx([min(values), cuts[4], cuts[9], cuts[18], max(values)])
    assert order.quantiles(df.where("false"), ["x"], (0.5,)) == {}
