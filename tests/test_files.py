"""Line numbers of bad rows, immutable JSON files, and waits that a server asks for."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from sentrel.sources import ingest, manifests, pages, sink, snapshots


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def line(i, **other):
    return json.dumps({"report_id": f"r{i}", "received_date": "2025-01-02", "drug_name": "A", "reaction": "Xé" * (i % 7), "serious": True} | other, ensure_ascii=False)


def test_bad_line_is_named_by_file_and_number(spark, tmp_path, small_splits):
    good = [line(i) for i in range(1, 400)]
    good[50] = ""
    (tmp_path / "a.jsonl").write_text("\n".join(good) + "\n", encoding="utf-8")
    rows = snapshots.observations(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 20 and rows.count() == 398 and rows.columns[:4] == ["report_id", "received_date", "drug", "drug_role"]
    for at, text in ((1, "{"), (200, line(1, received_date="2025-13-01")), (317, line(1, drug_name=None)), (399, "[1]"), (52, " ")):
        lines = [*good]
        lines[at - 1] = text
        (tmp_path / "b.jsonl").write_text("\r\n".join(lines), encoding="utf-8")
        with pytest.raises(ValueError, match=f"line {at} of .*b.jsonl"):
            snapshots.observations(spark, str(tmp_path))
        with pytest.raises(Exception, match="invalid curated row"):
            snapshots.observations(spark, str(tmp_path), check=False).collect()


def test_every_split_names_its_first_bad_line(spark, tmp_path, small_splits):
    lines = [f"line {i}" if i % 90 else "bad" for i in range(1, 1001)]
    (tmp_path / "x.txt").write_text("\n".join(lines))
    found = snapshots.first_bad_lines(spark, str(tmp_path), F.col("value") == "bad").collect()
    assert len(found) > 5 and {r.line for r in found} <= {i for i in range(90, 1001, 90)} and min(r.line for r in found) == 90


def files(path):
    return {p: (path / p).read_bytes() for p in os.listdir(path) if not p.startswith(".")} if path.exists() else {}


def test_files_are_canonical_immutable_and_all_or_none(spark, tmp_path):
    spark.dataSource.register(sink.JsonFiles)
    out = tmp_path / "out"
    save = lambda rows, n=3: spark.createDataFrame(rows, "name string, content string").repartition(n).write.format("json_files").mode("append").save(str(out))
    rows = [(f"p{i}.json", json.dumps({"b": i, "a": "ü"})) for i in range(9)]
    save(rows)
    want = {f"p{i}.json": ('{"a":"ü","b":%d}\n' % i).encode() for i in range(9)}
    assert files(out) == want
    before = {p: os.stat(out / p).st_mtime_ns for p in want}
    save([(n, json.dumps(json.loads(c), indent=3)) for n, c in rows])
    assert {p: os.stat(out / p).st_mtime_ns for p in files(out)} == before
    for bad in ([("new.json", "{}"), ("p3.json", '{"b": 4}')], [("new.json", "{}"), ("q.json", "not JSON")], [("new.json", "1"), ("new.json", "2")], [("new.json", "{}"), ("../q.json", "{}")]):
        with pytest.raises(Exception, match="content|Expecting|file name"):
            save(bad)
        assert files(out) == want
    with pytest.raises(Exception, match="never overwritten"):
        spark.createDataFrame(rows, "name string, content string").write.format("json_files").mode("overwrite").save(str(out))
    save([("new.json", "[1, 2]")])
    assert files(out) == want | {"new.json": b"[1,2]\n"}


def test_stored_pages_become_page_files(spark, tmp_path):
    asked = manifests.manifest("openfda", {"manifest_version": 1, "snapshot_id": "s-1", "search": "x", "page_size": 2, "max_records": 4})
    folder = f"{tmp_path}/raw/openfda/s-1/pages"
    rows = [(0, 2, ['{"id": 1, "t": "é"}', '{"id": 2}'], asked.digest), (2, 1, ['{"id": 3}'], asked.digest)]
    made = spark.createDataFrame(rows, "skip long, records long, payloads array<string>, manifest_digest string").withColumn("sha256", ingest.digest())
    made.select(*[c.split()[0] for c in ingest.PAGES.split(", ")]).write.parquet(folder)
    for _ in range(2):
        path = ingest.export_pages(spark, str(tmp_path), asked)
    found = snapshots.raw_pages(spark, path).orderBy("page", "index").collect()
    assert [(r.page, r["index"], json.loads(r.payload)["id"]) for r in found] == [("page-000000000.json", 0, 1), ("page-000000000.json", 1, 2), ("page-000000002.json", 0, 3)]
    text = open(f"{path}/page-000000000.json", "rb").read()
    assert text == manifests.canonical(json.loads(text)) and "é".encode() in text


def test_canonical_json():
    assert manifests.canonical({"b": "é", "a": [1, None]}) == '{"a":[1,null],"b":"é"}\n'.encode()


def test_waits_that_the_server_asks_for():
    now = dt.datetime(2025, 1, 1, 12, 0, 0, tzinfo=dt.UTC)
    wait = lambda h, attempt=3: pages.delay(attempt, h, 0.5, now)
    assert wait("7") == 7 and wait("1.5") == 1.5 and wait("-3") == 0 and wait(" 2 ") == 2
    assert wait("Wed, 01 Jan 2025 12:00:09 GMT") == 9 and wait("Wed, 01 Jan 2025 11:00:00 GMT") == 0
    assert wait(None) == wait("") == wait("soon") == wait("nan") == 2.0 and wait("soon", 1) == 0.5
