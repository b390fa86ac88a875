"""Quarterly ZIP archives: fetched in byte ranges, pinned by digest, read member by member.

An archive is a table of its byte ranges, which is the resume point as well: a rerun fetches the
ranges that are missing. Members are inflated where their ranges are, range by range, so no task
holds an archive; a member's CRC is tested on the way.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import struct
import urllib.error
import urllib.request
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES, MAX_BYTES = 8 << 20, 100_000_000
#: A ZIP file's directory ends with a record and a comment of at most this many bytes together.
DIRECTORY_END = 22 + 65_535

PARTS = "start long, length long, bytes binary, sha256 string, total long, etag string"
LOCK = "quarter string, source_url string, retrieved_at timestamp, bytes long, sha256 string, etag string, last_modified string"
LINES = "member string, line long, value string"
#: Of an entry of a ZIP file: where its data starts, once its own header is known, and how it is compressed.
LOCAL_HEADER = "<26xHH"


@dataclass
class Span(InputPartition):
    start: int
    length: int


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Span]:
        return [Span(*map(int, s.split("+"))) for s in self.options["spans"].split(",")]

    def read(self, partition: Span):
        """One row: the range's bytes, or the reason why they could not be had, so that a broken transfer costs only itself."""
        head = {"Range": f"bytes={partition.start}-{partition.start + partition.length - 1}"} | ({"If-Match": self.options["etag"]} if self.options.get("etag") else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(self.options["url"], headers=head), timeout=float(self.options.get("timeout", 120))) as reply:
                data = reply.read(partition.length + 1)
                if reply.status != 206 and partition.start:
                    data, problem = None, "the server sends no ranges"
                else:
                    problem = None if len(data) == partition.length else f"{len(data)} bytes"
        except (OSError, urllib.error.URLError) as error:
            data, problem = None, str(error)
        yield partition.start, None if problem else data, problem


class ByteRanges(DataSource):
    """spark.read.format("byte_ranges").options(url=, spans="0+100,100+80").load()"""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "start long, bytes binary, problem string"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    target, files = _path(spark, path)
    return files.exists(target)


def _drop(spark: SparkSession, path: str) -> None:
    target, files = _path(spark, path)
    files.delete(target, True)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored ranges of an archive; empty before the first."""
    if not _there(spark, f"{folder}/parts"):
        return spark.createDataFrame([], PARTS)
    return spark.read.schema(PARTS).parquet(f"{folder}/parts")


def _asked(url: str, timeout: float) -> tuple[int, str | None, str | None]:
    """Length, tag and date that the server gives for a file."""
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as reply:
        length = reply.headers.get("Content-Length")
        if length is None:
            raise ValueError(f"the server does not say how long {url} is")
        return int(length), reply.headers.get("ETag"), reply.headers.get("Last-Modified")


def digest(ranges: DataFrame) -> tuple[int, str]:
    """Bytes and SHA-256 of an archive: one sequence, so one task streams its ranges in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, size = hashlib.sha256(), 0
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if start != size:
                    raise ValueError(f"bytes {size} to {start} are missing")
                view = data.as_buffer()
                whole.update(view)
                size += view.size
        yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([whole.hexdigest()])], names=["size", "sha"])

    found = ranges.select("start", "bytes").coalesce(1).sortWithinPartitions("start").mapInArrow(run, "size long, sha string").first()
    return found["size"], found["sha"]


class _End(io.RawIOBase):
    """A file of which only the end is at hand."""

    def __init__(self, size: int, data: bytes):
        self.size, self.data, self.at = size, data, 0

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence] + offset)
        return self.at

    def read(self, n: int = -1) -> bytes:
        lo = self.at - (self.size - len(self.data))
        if lo < 0:
            raise EOFError(self.at)
        out = self.data[lo:] if n < 0 else self.data[lo : lo + n]
        self.at += len(out)
        return out


def directory(spark: SparkSession, ranges: DataFrame) -> list[zipfile.ZipInfo]:
    """Entries of an archive's directory; the driver reads no more than the ranges that hold it."""
    size = ranges.agg(F.max(F.col("start") + F.col("length"))).first()[0] or 0
    reach = DIRECTORY_END
    while True:
        tail = b"".join(bytes(r.bytes) for r in ranges.where(F.col("start") + F.col("length") > size - reach).orderBy("start").select("bytes").collect())
        try:
            with zipfile.ZipFile(_End(size, tail)) as archive:
                return [i for i in archive.infolist() if not i.is_dir()]
        except EOFError as error:  # the directory starts before what was read
            reach = size - int(error.args[0])
        except zipfile.BadZipFile as error:
            raise ValueError("not a ZIP file") from error


def _inflated(entries: dict[str, tuple[int, int, int, int, int]]):
    """Lines of every member from its ranges, sorted by member and start; a closing row (line 0) has the CRC that was found."""

    def opened(member: str) -> dict[str, Any]:
        offset, size, _, method, _ = entries[member]
        return {"name": member, "skip": offset, "head": None, "left": size, "method": method, "inflate": zlib.decompressobj(-15), "crc": 0, "size": 0, "line": 0, "rest": b""}

    def fed(m: dict[str, Any], start: int, data: bytes, out: list[tuple]) -> None:
        data = data[max(0, m["skip"] - start) :]
        if m["head"] is None or len(m["head"]) < m["need"]:  # the entry's own header, which may span two ranges
            m["head"] = (m["head"] or b"") + data
            m["need"] = 30 + sum(struct.unpack_from(LOCAL_HEADER, m["head"])) if len(m["head"]) >= 30 else 30
            if len(m["head"]) < m["need"]:
                return
            if m["head"][:4] != b"PK\3\4":
                raise ValueError(f"{m['name']}: no entry where the directory says")
            data = m["head"][m["need"] :]
        data = data[: m["left"]]
        m["left"] -= len(data)
        for lo in range(0, len(data), 1 << 18):  # little at a time, as what inflates may be much larger
            piece = data[lo : lo + (1 << 18)]
            text = piece if m["method"] == zipfile.ZIP_STORED else m["inflate"].decompress(piece)
            m["crc"], m["size"] = zlib.crc32(text, m["crc"]), m["size"] + len(text)
            *whole, m["rest"] = (m["rest"] + text).split(b"\n")
            for x in whole:
                m["line"] += 1
                out.append((m["name"], m["line"], x.removesuffix(b"\r").decode("utf-8", "replace")))

    def closed(m: dict[str, Any], out: list[tuple]) -> None:
        tail = b"" if m["method"] == zipfile.ZIP_STORED else m["inflate"].flush()
        m["crc"], m["size"] = zlib.crc32(tail, m["crc"]), m["size"] + len(tail)
        for x in (m["rest"] + tail).split(b"\n"):
            if x:
                m["line"] += 1
                out.append((m["name"], m["line"], x.removesuffix(b"\r").decode("utf-8", "replace")))
        out.append((m["name"], 0, f"{m['crc']} {m['size']}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["member", "line", "value"])

        m, out = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                if m is None or m["name"] != name:
                    if m:
                        closed(m, out)
                    m = opened(name)
                fed(m, batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), out)
                if len(out) > 20_000:
                    yield table(out)
                    out = []
        if m:
            closed(m, out)
        yield table(out)

    return run


def _streams(spark: SparkSession, ranges: DataFrame, listed: list[zipfile.ZipInfo]) -> DataFrame:
    """Rows of ``_inflated`` for the listed entries; each member's ranges go to one task, in order."""
    unknown = [i.filename for i in listed if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or i.flag_bits & 1]
    if unknown:
        raise ValueError(f"compression or encryption that is not supported: {unknown}")
    entries = {i.filename: (i.header_offset, i.compress_size, i.CRC, i.compress_type, i.file_size) for i in listed}
    # an entry's own header may be longer than the directory's by its extra field
    spans = spark.createDataFrame([(name, e[0], e[0] + 30 + 2 * 65_535 + e[1]) for name, e in entries.items()], "member string, lo long, hi long")
    held = ranges.join(F.broadcast(spans), (F.col("start") < F.col("hi")) & (F.col("start") + F.col("length") > F.col("lo"))).select("member", "start", "bytes")
    return held.repartition(max(1, len(entries)), "member").sortWithinPartitions("member", "start").mapInArrow(_inflated(entries), LINES)


def corrupt_members(spark: SparkSession, ranges: DataFrame) -> list[str]:
    """Members whose bytes do not have the size and CRC that the directory says."""
    listed = directory(spark, ranges)
    if not listed:
        raise ValueError("an archive without members")
    found = {r.member: r.value for r in _streams(spark, ranges, listed).where("line = 0").collect()}
    return [i.filename for i in listed if found.get(i.filename) != f"{i.CRC} {i.file_size}"]


def _checked(spark: SparkSession, ranges: DataFrame, archive: dict[str, Any]) -> tuple[int, str]:
    """Size and digest of complete ranges; refused if the pin, the directory or a member's CRC is wrong."""
    size, sha = digest(ranges)
    if archive.get("expected_sha256") not in (None, sha):
        raise ValueError(f"SHA-256 of {archive['quarter']} is {sha}, not the one that is pinned")
    try:
        bad = corrupt_members(spark, ranges)
    except zlib.error as error:
        raise ValueError(f"corrupt archive {archive['quarter']}") from error
    except Exception as error:  # a task's own error comes wrapped
        if "zlib.error" in str(error) or "no entry where" in str(error):
            raise ValueError(f"corrupt archive {archive['quarter']}") from error
        raise
    if bad:
        raise ValueError(f"corrupt members of {archive['quarter']}: {bad}")
    return size, sha


def fetch(spark: SparkSession, root: str, archive: dict[str, Any], max_bytes: int = MAX_BYTES, range_bytes: int = RANGE_BYTES, timeout: float = 120) -> dict[str, Any]:
    """Fetch an archive of a quarterly manifest (``manifests.archives``) and pin its digest; the lock's fields.

    What a broken transfer has brought stays and is not asked for again, as long as the server still
    has the same file. A file above ``max_bytes``, with another digest than the manifest pins, or
    with a directory or member that does not hold is refused and its ranges are dropped. An archive
    that is there is verified instead: same quarter and address, same bytes, sound members.
    """
    if max_bytes <= 0:
        raise ValueError("max_bytes must be positive")
    folder = f"{root.rstrip('/')}/archives/{archive['quarter']}"
    if _there(spark, f"{folder}/lock"):
        lock = spark.read.schema(LOCK).json(f"{folder}/lock").first()
        if (lock.quarter, lock.source_url) != (archive["quarter"], archive["url"]):
            raise ValueError(f"the archive of {archive['quarter']} has another origin")
        if _checked(spark, parts(spark, folder), archive) != (lock.bytes, lock.sha256):
            raise ValueError(f"the archive of {archive['quarter']} changed")
        return lock.asDict()
    total, etag, modified = _asked(archive["url"], timeout)
    if total > max_bytes:
        _drop(spark, f"{folder}/parts")
        raise ValueError(f"{archive['quarter']} exceeds {max_bytes} bytes")
    stored = parts(spark, folder)
    if not stored.where(~(F.col("total").eqNullSafe(total) & F.col("etag").eqNullSafe(etag))).isEmpty():
        _drop(spark, f"{folder}/parts")  # ranges of another file
        stored = parts(spark, folder)
    sound = {r.start for r in stored.where(F.col("sha256") == F.sha2("bytes", 256)).select("start").collect()}
    wanted = [(at, min(range_bytes, total - at)) for at in range(0, total, range_bytes) if at not in sound]
    if wanted:
        spark.dataSource.register(ByteRanges)
        source = spark.read.format("byte_ranges").options(url=archive["url"], spans=",".join(f"{a}+{n}" for a, n in wanted), timeout=str(timeout), **({"etag": etag} if etag else {}))
        got = source.load().where("problem is null").select("start", F.octet_length("bytes").cast("long").alias("length"), "bytes", F.sha2("bytes", 256).alias("sha256"), F.lit(total).cast("long").alias("total"), F.lit(etag).cast("string").alias("etag"))
        got.write.mode("append").parquet(f"{folder}/parts")
        stored = parts(spark, folder)
        left = sorted({a for a, _ in wanted} - {r.start for r in stored.select("start").collect()})
        if left:
            raise OSError(f"{len(left)} of {len(wanted)} ranges of {archive['quarter']} did not come, the first at byte {left[0]}; run again to fetch them")
    try:
        size, sha = _checked(spark, stored, archive)
    except ValueError:
        _drop(spark, f"{folder}/parts")
        raise
    lock = (archive["quarter"], archive["url"], dt.datetime.now(dt.UTC), size, sha, etag, modified)
    spark.createDataFrame([lock], LOCK).coalesce(1).write.mode("errorifexists").json(f"{folder}/lock")
    return dict(zip([c.split()[0] for c in LOCK.split(", ")], lock, strict=True))


def lines(spark: SparkSession, root: str, quarter: str, pattern: str = "") -> DataFrame:
    """member, line (from 1), value of the text members of a locked archive whose path has ``pattern`` (any case)."""
    folder = f"{root.rstrip('/')}/archives/{quarter}"
    if not _there(spark, f"{folder}/lock"):
        raise ValueError(f"no locked archive of {quarter}")
    ranges = parts(spark, folder)
    chosen = [i for i in directory(spark, ranges) if pattern.lower() in i.filename.lower() and i.filename.lower().endswith(".txt")]
    return _streams(spark, ranges, chosen).where("line > 0") if chosen else spark.createDataFrame([], LINES)


def records(spark: SparkSession, root: str, quarter: str, pattern: str) -> DataFrame:
    """member, line and the fields of the ``$``-separated members that ``pattern`` finds, named by their first line.

    Members with different first lines are refused; a field that a line lacks is null, as is an empty one.
    """
    rows = lines(spark, root, quarter, pattern)
    heads = {r.value for r in rows.where("line = 1").collect()}
    if len(heads) != 1:
        raise ValueError(f"members of {quarter} that hold {pattern!r} have {len(heads)} kinds of fields")
    names = [n.strip().lower() for n in heads.pop().lstrip("﻿").split("$")]
    cells = F.split("value", r"\$", -1)
    return rows.where("line > 1").select("member", "line", *[F.nullif(F.get(cells, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names) if n])
