"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers begin a new token at a single space between two other characters, so a text falls
apart there into units, and what both make of a unit is worked out once a task. DuckDB aligns the
units that a task has not met before: interval tables of both tokenizers' tokens, a range join for
the ends they share, window sums that number the groups between these, ASOF joins that put every
token into its group. The pair counts of a slice of texts are partial; Spark merges them.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import raw, slices, strings

MEMO_UNITS, SLICE_BYTES = 300_000, 1 << 20
#: A space between two characters that are not white space (for Python's wider notion of it).
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"

ALIGNED = "kind int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>, pairs array<int>, counts array<long>"
NAMES = [c.split()[0] for c in ALIGNED.split(", ")]

#: Tokens of a run of units, by the offsets where they stop, to (group, side, stop, id, whether both sides stop there).
ALIGN = """
    WITH a AS (SELECT stop, id, lag(stop, 1, 0) OVER (ORDER BY stop) AS start FROM tokens_a),
    b AS (SELECT stop, id, lag(stop, 1, 0) OVER (ORDER BY stop) AS start FROM tokens_b),
    -- of the tokens that overlap, those that stop together make a cut
    cuts AS MATERIALIZED (SELECT a.stop, sum(1) OVER (ORDER BY a.stop) AS grp FROM a JOIN b ON a.stop = b.stop AND a.start < b.stop AND b.start < a.stop)
    SELECT grp, 0 AS side, t.stop, id, c.stop = t.stop AS cut FROM tokens_a t ASOF JOIN cuts c ON t.stop <= c.stop
    UNION ALL
    SELECT grp, 1 AS side, t.stop, id, c.stop = t.stop AS cut FROM tokens_b t ASOF JOIN cuts c ON t.stop <= c.stop
    ORDER BY grp, side, stop
"""


_aligners: dict[tuple, Aligner] = {}


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others in order for the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens and every pair of ids that can be linked.

    Linked tokens end together, so one's bytes end the other's: the possible pairs are no more than
    twice the bytes of both vocabularies, whatever the corpus.
    """

    def __init__(self, byte_file: str, piece_file: str, pairs: np.ndarray | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        chars = byte_level()
        self.bytes_a = {i: bytes(chars[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in chars for c in t)}
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not (self.b.is_control(i) or self.b.is_unknown(i))}
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in pieces.items()}
        self.split = all(SPACE not in p.lstrip(SPACE) for p in pieces.values())
        self.pairs = self.possible() if pairs is None else pairs

    def possible(self) -> np.ndarray:
        """Sorted pairs of ids of which one's bytes end the other's."""
        found = set()
        for ours, theirs, swap in ((self.bytes_a, self.bytes_b, False), (self.bytes_b, self.bytes_a, True)):
            by: dict[bytes, list[int]] = {}
            for i, t in theirs.items():
                by.setdefault(t, []).append(i)
            for i, t in ours.items():
                for k in range(len(t)):
                    found.update(((j, i) if swap else (i, j)) for j in by.get(t[k:], ()))
        return np.array(sorted(a << 32 | b for a, b in found), np.int64)

    def tokens(self, units: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which units (each begins with a space) have tokens of their own bytes; (ids, stops) of both tokenizers over these, joined."""
        data = [u.encode() for u in units]
        two = self.b.encode([u[1:] for u in units], num_threads=1)
        good = np.array([d == b"".join([self.bytes_b.get(i, b"") for i in ids]) != b" " for d, ids in zip(data, two, strict=True)], bool)
        kept = [u for u, g in zip(units, good, strict=True) if g]
        # A begins anew at every unit, so units can share a call
        runs = ["".join(kept[i : i + 1000]) for i in range(0, len(kept), 1000)] if self.split else kept
        one = [i for e in self.a.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids]
        other = [i for g, ids in zip(good, two, strict=True) if g for i in ids]
        out = []
        for ids, table in ((one, self.bytes_a), (other, self.bytes_b)):
            parts = [table.get(i, b"") for i in ids]
            if b"".join(parts) != b"".join([d for d, g in zip(data, good, strict=True) if g]):
                raise ValueError("the byte-level tokenizer's tokens are not the bytes of the text")
            out.append((np.array(ids, np.int32), np.cumsum([len(p) for p in parts], dtype=np.int64)))
        return good, out


class Aligner:
    """Aligned units of one worker."""

    def __init__(self, byte_file: str, piece_file: str, memo_units: int, pairs: np.ndarray | None = None):
        self.words = Vocabularies(byte_file, piece_file, pairs)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self.memo_units = memo_units
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes | None] = []  # None: no tokens
        self.sizes = [np.zeros((0, 2), np.int64)]  # tokens of both kinds
        self.links = [np.zeros(0, np.int32)]
        self.n_links = [np.zeros(0, np.int64)]

    def learn(self, units: list[str]) -> None:
        """Align units that are not known yet."""
        good, both = self.words.tokens(units)
        places = np.flatnonzero(good)
        ends = np.cumsum([len(units[u].encode()) for u in places], dtype=np.int64)
        sizes = np.zeros((len(units), 2), np.int64)
        for i, (ids, stops) in enumerate(both):
            sizes[places, i] = np.diff(np.searchsorted(stops, ends, side="right"), prepend=0)
            self.db.register(f"tokens_{'ab'[i]}", pa.table({"id": ids, "stop": stops}))
        found = self.db.sql(ALIGN).to_arrow_table()
        side, stop, ids, cut = (found.column(k).to_numpy() for k in ("side", "stop", "id", "cut"))
        unit = np.searchsorted(ends, stop)
        mark = np.where(~cut, ",", np.where(side == 0, "|", np.where(ends[unit] == stop, "", ";"))) if len(unit) else np.zeros(0, "U1")
        written = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), pa.array(mark, pa.string()), "")
        data, offsets = raw(written.cast(pa.large_string()))
        text, first = data.tobytes(), np.searchsorted(unit, np.arange(len(places) + 1))
        at = offsets[first].tolist()
        groups: list[bytes | None] = [None] * len(units)
        for u, lo, hi in zip(places.tolist(), at, at[1:], strict=False):
            groups[u] = text[lo:hi]
        ours, theirs = cut & (side == 0), cut & (side == 1)
        pair = ids[ours].astype(np.int64) << 32 | ids[theirs]
        n_links = np.zeros(len(units), np.int64)
        n_links[places] = np.bincount(unit[ours], minlength=len(places))
        self.known.update(zip(units, range(len(self.groups), len(self.groups) + len(units)), strict=True))
        self.groups += groups
        self.sizes.append(sizes)
        self.n_links.append(n_links)
        self.links.append(np.searchsorted(self.words.pairs, pair).astype(np.int32))

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the units of every text; none for an empty one."""
        split = BOUNDARY.split if self.words.split else lambda t: [t]
        cut = [[" " + u for u in split(t)] if t else [] for t in texts]
        if len(self.known) > self.memo_units:
            self.clear()
        new = list({u: None for units in cut for u in units if u not in self.known})
        if new:
            self.learn(new)
        known = self.known
        return [[known[u] for u in units] for units in cut]

    def aligned(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """n_a, n_b, n_groups, digest and links (numbers of pairs) of each text."""
        cut = self.numbers(texts)
        sizes, links, n_links = (np.concatenate(x) for x in (self.sizes, self.links, self.n_links))
        self.sizes, self.links, self.n_links = [sizes], [links], [n_links]
        first = np.cumsum(n_links) - n_links
        for units in cut:
            groups = [self.groups[u] for u in units]
            if not units or None in groups:
                yield 0, 0, 0, "", links[:0]
                continue
            at = np.array(units)
            n = n_links[at]
            total = int(n.sum())
            places = np.arange(total) + np.repeat(first[at] - (np.cumsum(n) - n), n)
            a, b = sizes[at].sum(axis=0).tolist()
            yield a, b, total, hashlib.sha256(b";".join(groups)).hexdigest(), links[places]


def _aligned(byte_file: str, piece_file: str, memo_units: int, pairs: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (byte_file, piece_file, memo_units)
        if key not in _aligners:  # a worker keeps what it has learnt for its next task
            _aligners.clear()
            _aligners[key] = Aligner(*key, pairs.value)
        aligner = _aligners[key]
        for batch in batches:
            texts = strings(batch.column(1), lower=False)
            for lo, part in slices(texts, SLICE_BYTES):
                rows = list(aligner.aligned(part.to_pylist()))
                links = np.concatenate([r[4] for r in rows])
                ends = np.concatenate(([0], np.cumsum([len(r[4]) for r in rows]))).astype(np.int32)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), batch.column(0).slice(lo, n), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows], pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(links)), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))],
                    names=NAMES,
                )
                pair, count = np.unique(links, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.array([pair], pa.list_(pa.int32())), pa.array([count], pa.list_(pa.int64()))], names=NAMES)

    return run


def _counted(counts: np.ndarray, best: np.ndarray):
    """Sums over the links of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(5)
            links, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            ends = np.concatenate(([0], np.cumsum(n)))
            sums = [np.concatenate(([0], np.cumsum(x[links]))) for x in (best.astype(np.int64), counts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(n.astype(np.int64)), *[pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums], batch.column(4)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return count


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count: partial counts of the slices of texts, merged."""
    partial = aligned.where("kind = 1").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    return partial.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", memo_units: int = MEMO_UNITS) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level tokenizer on a space and the text, B the piece model on the text; offsets where
    tokens of both end cut the tokens into groups, and the two tokens that end there are linked.
    ``n_best`` counts the links whose pair is, over the whole table, the most frequent one of its B id
    (ties included), ``count_sum`` sums the table-wide counts of the links' pairs. Strings of special
    tokens are plain text. Texts that are null or empty, or whose tokens' bytes are not a space and the
    text, have no tokens: zeros and ''. Repeated rows count each; an empty table gives an empty result;
    other columns are not read. The driver receives one count a possible pair, which the two
    vocabularies bound (:class:`Vocabularies`).
    """
    store = Scratch(docs.sparkSession)
    words = Vocabularies(byte_file, piece_file)
    pairs = docs.sparkSession.sparkContext.broadcast(words.pairs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    aligned = store.written(rows.mapInArrow(_aligned(byte_file, piece_file, memo_units, pairs), ALIGNED), "aligned")
    counts = np.zeros(len(words.pairs), np.int64)
    merged = pair_counts(aligned).toPandas()
    counts[merged["pair"].to_numpy(np.int64)] = merged["count"].to_numpy(np.int64)
    most = np.zeros(max(words.bytes_b, default=0) + 1, np.int64)
    b = words.pairs & 0xFFFFFFFF
    np.maximum.at(most, b, counts)
    result = aligned.where("kind = 0").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    result = store.written(result.mapInArrow(_counted(counts, counts == most[b]), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), "alignment")
    store.clear(result)
    return result
