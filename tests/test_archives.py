"""Archives from a local server that breaks transfers, with wrong digests, CRCs and sizes."""

import hashlib
import io
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sentrel.sources import archives


def packed(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


MEMBERS = {
    "ascii/": "",
    "ascii/DEMO24Q1.txt": "primaryid$caseid$sex\r\n" + "".join(f"{i}$c{i}${'MF'[i % 2] if i % 5 else ''}\r\n" for i in range(3000)),
    "ascii/DRUG24Q1.txt": "primaryid$drugname\n1$AS$PIRIN\n2$é",
    "readme.pdf": "no text " * 50,
}


@pytest.fixture
def server():
    """Serves ``files``; a range whose start is in ``broken`` is cut short once."""
    state = {"files": {}, "broken": set(), "asked": []}

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.reply(head=True)

        def do_GET(self):
            self.reply()

        def reply(self, head=False):
            data = state["files"][self.path]
            lo, hi = 0, len(data) - 1
            if "Range" in self.headers:
                lo, hi = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
                state["asked"].append(lo)
            self.send_response(206 if "Range" in self.headers else 200)
            self.send_header("Content-Length", str(hi - lo + 1))
            self.send_header("ETag", hashlib.md5(data).hexdigest())
            self.end_headers()
            if head:
                return
            part = data[lo : hi + 1]
            if lo in state["broken"]:
                state["broken"].discard(lo)
                part = part[: len(part) // 2]
            self.wfile.write(part)

        def log_message(self, *a):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{http.server_port}"
    yield state
    http.shutdown()


def test_broken_transfer_is_resumed_and_members_are_rows(spark, server, tmp_path):
    data = packed(MEMBERS)
    server["files"]["/a.zip"], server["broken"] = data, {1000, 3000}
    archive = {"quarter": "2024Q1", "url": f"{server['url']}/a.zip", "expected_sha256": hashlib.sha256(data).hexdigest()}
    with pytest.raises(OSError, match="2 of"):
        archives.fetch(spark, str(tmp_path), archive, range_bytes=1000)
    with pytest.raises(ValueError, match="no locked"):
        archives.lines(spark, str(tmp_path), "2024Q1")
    before = len(server["asked"])
    lock = archives.fetch(spark, str(tmp_path), archive, range_bytes=1000)
    assert sorted(server["asked"][before:]) == [1000, 3000]
    assert (lock["bytes"], lock["sha256"]) == (len(data), archive["expected_sha256"])
    again = archives.fetch(spark, str(tmp_path), archive, range_bytes=1000)
    assert len(server["asked"]) == before + 2 and again["sha256"] == lock["sha256"]
    demo = archives.records(spark, str(tmp_path), "2024Q1", "demo")
    assert demo.columns == ["member", "line", "primaryid", "caseid", "sex"] and demo.count() == 3000
    row = demo.where("primaryid = '6'").first()
    assert (row.member, row.line, row.caseid, row.sex) == ("ascii/DEMO24Q1.txt", 8, "c6", "M")
    assert demo.where("sex is null").count() == 600
    drug = archives.records(spark, str(tmp_path), "2024Q1", "DRUG").orderBy("line").collect()
    assert [(r.primaryid, r.drugname) for r in drug] == [("1", "AS"), ("2", "é")]
    assert archives.lines(spark, str(tmp_path), "2024Q1", "readme").count() == 0


def test_stored_members_and_one_range(spark, server, tmp_path):
    server["files"]["/s.zip"] = packed(MEMBERS, zipfile.ZIP_STORED)
    archives.fetch(spark, str(tmp_path), {"quarter": "2024Q2", "url": f"{server['url']}/s.zip"})
    assert archives.lines(spark, str(tmp_path), "2024Q2", "demo").count() == 3001


@pytest.mark.parametrize("size", [7, 40, 300])
def test_ranges_may_cut_headers_and_lines(spark, server, tmp_path, size):
    small = {k: v[:200] for k, v in MEMBERS.items()}
    server["files"]["/t.zip"] = packed(small)
    archives.fetch(spark, str(tmp_path), {"quarter": "2024Q3", "url": f"{server['url']}/t.zip"}, range_bytes=size)
    got = {}
    for r in archives.lines(spark, str(tmp_path), "2024Q3").orderBy("member", "line").collect():
        got.setdefault(r.member, []).append(r.value)
    assert got == {k: v.splitlines() for k, v in small.items() if k.endswith(".txt")}


def test_wrong_digest_crc_size_and_kind_are_refused(spark, server, tmp_path):
    data = packed({"a.txt": "x$y\n" * 400}, zipfile.ZIP_STORED)
    spoilt = data.replace(b"x$y\nx$y\n", b"x$z\nx$y\n", 1)
    server["files"] |= {"/a.zip": data, "/bad.zip": spoilt, "/none.zip": b"plain text", "/empty.zip": packed({})}
    at = lambda name, **more: {"quarter": "2024Q4", "url": f"{server['url']}/{name}.zip", **more}
    for archive, options, said in (
        (at("a", expected_sha256="0" * 64), {}, "pinned"), (at("bad"), {}, "corrupt members"), (at("none"), {}, "not a ZIP"), (at("empty"), {}, "without members"), (at("a"), {"max_bytes": 100}, "exceeds"), (at("a"), {"max_bytes": 0}, "positive"),
    ):
        with pytest.raises(ValueError, match=said):
            archives.fetch(spark, str(tmp_path), archive, **options)
        assert archives.parts(spark, f"{tmp_path}/archives/2024Q4").count() == 0
    archives.fetch(spark, str(tmp_path), at("a"))
    with pytest.raises(ValueError, match="origin"):
        archives.fetch(spark, str(tmp_path), at("bad"))


def test_ranges_of_another_file_are_dropped(spark, server, tmp_path):
    server["files"]["/a.zip"], server["broken"] = packed({"a.txt": "one\n" * 900}, zipfile.ZIP_STORED), {1000}
    archive = {"quarter": "2025Q1", "url": f"{server['url']}/a.zip"}
    with pytest.raises(OSError):
        archives.fetch(spark, str(tmp_path), archive, range_bytes=1000)
    server["files"]["/a.zip"] = packed({"a.txt": "two\n" * 900}, zipfile.ZIP_STORED)
    archives.fetch(spark, str(tmp_path), archive, range_bytes=1000)
    assert archives.lines(spark, str(tmp_path), "2025Q1").where("value = 'two'").count() == 900
