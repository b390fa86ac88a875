"""Removal of passages that repeat across documents, from the collection's sorted suffixes.

Two equal strings of 50 bytes have the same smallest 24-byte anchor (by hash) at the same place. A
text is cut into pieces, maximal runs of such strings with one anchor; equal strings lie in pieces
of one anchor, so anchors part the work without losing an equality. Texts stay where they are: they
are written once, in chunks of a few megabytes, and every later step groups that table by chunk
without moving it. A chunk asks for two things, by blocks of keys a bucket of anchors:

1. which of its anchors occur more than once in the collection, answered by one bit each;
2. for its different pieces at such anchors, the smallest document that holds each of their strings.

The second answer comes from the pieces themselves. Different pieces of one anchor are built up as
a collection column by column (:func:`sorted_collection`): each round inserts one symbol of every
piece into the Burrows-Wheeler transform, by one pass over what the rounds before have left, and
updates the common prefixes of neighbours. Strings with a common prefix of 50 bytes are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import mix, raw, strings

LENGTH, ANCHOR = 50, 24
#: Anchors in a string of LENGTH, which is also the most strings a piece has.
SPAN = LENGTH - ANCHOR + 1
WIDTH = 80  # bytes a piece takes in a matrix: LENGTH + SPAN - 1, padded
CHUNK_BYTES, BLOCK = 4 << 20, 1 << 15
#: Anchors a bucket, pieces a collection, and further contents of an anchor from which its strings are dealt out singly.
BUCKET_KEYS, COLLECTION, HOT = 1 << 20, 1 << 13, 4096
KEY_BITS = 48
LAST = np.iinfo(np.int64).max

_odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]

CHUNKED = "chunk long, doc_id long, text string"
ASKED = "bucket long, chunk long, keys binary, counts binary"
SHARED = "chunk long, bucket long, kind int, n long, first binary, second binary"
PIECES = "bucket long, chunk long, keys binary, sizes binary, bytes binary, docs binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows of numbers, bytes and strings as an Arrow table of a schema text."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a task in chunks of CHUNK_BYTES of text; a longer text stands alone."""
    chunk, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        texts = strings(batch.column(1), lower=False)
        _, offsets = raw(texts)
        numbers = np.empty(len(texts), np.int64)
        for i, size in enumerate(np.diff(offsets).tolist()):
            if held and held + size > CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            held += size + 1
            numbers[i] = chunk
        yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0), texts.cast(pa.string())], names=["chunk", "doc_id", "text"])


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first byte, strings) of every piece: runs of starts of strings that have one smallest anchor.

    A run is cut after SPAN strings (where a text repeats with a short period) and between blocks,
    which adds pieces but moves no string to another key.
    """
    n = len(data)
    edge = np.zeros(n + 1, np.int32)  # starts too near the end of their text
    np.add.at(edge, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), 1)
    np.add.at(edge, offsets[1:], -1)
    short = np.cumsum(edge[:n], dtype=np.int32) > 0
    keys, starts, counts = [], [], []
    for lo in range(0, n - LENGTH + 1, BLOCK):
        seg = data[lo : lo + BLOCK + LENGTH - 1]
        x = seg.astype(np.uint64)
        for k in (1, 2, 4):  # eight bytes from each place on
            x = x[:-k] | (x[k:] << np.uint64(8 * k))
        m = len(seg) - ANCHOR + 1
        low = mix(x[:m] * _odd[0] + x[8 : 8 + m] * _odd[1] + x[16 : 16 + m] * _odd[2])
        size = 1
        while size < SPAN:  # smallest of SPAN anchors in a row
            step = min(size, SPAN - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        out = short[lo : lo + len(low)]
        cut = out.copy()
        cut[0] = True
        cut[1:] |= (low[1:] != low[:-1]) | out[:-1]
        at = np.flatnonzero(cut)
        count = np.diff(np.append(at, len(low)))
        valid = ~out[at]
        at, count = at[valid], count[valid]
        if len(count) and count.max() > SPAN:
            parts = -(-count // SPAN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at, count = np.repeat(at, parts) + nth * SPAN, np.minimum(np.repeat(count, parts) - nth * SPAN, SPAN)
        keys.append(mix(low[at] ^ _odd[3]) >> np.uint64(64 - KEY_BITS))
        starts.append(at + lo)
        counts.append(count)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)


def _matrix(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of pieces, one a row, padded with zeros."""
    at = np.arange(WIDTH)
    inside = at < sizes[:, None]
    return np.where(inside, data[np.where(inside, starts[:, None] + at, 0)], np.uint8(0)) if len(starts) else np.zeros((0, WIDTH), np.uint8)


def _same(keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, content of each ordered row): rows by key and hash, numbered by key, size and bytes compared in full."""
    fp = sizes.astype(np.uint64)
    for i, column in enumerate(rows.view(np.uint64).T):
        fp = mix(fp ^ (column * _odd[i]))
    order = np.lexsort((fp, keys))
    k, r, s = keys[order], rows[order].view(np.uint64), sizes[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (r[1:] != r[:-1]).any(axis=1)
    return order, np.cumsum(new) - 1


def _buckets(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the runs of sorted keys that lie in one bucket; buckets are ranges of keys."""
    bucket = keys // np.uint64(-(-(1 << KEY_BITS) // buckets))
    first = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    ends = [*first.tolist(), len(keys)] if len(keys) else []
    return list(zip(bucket[np.array([0, *first])[: len(ends)]].tolist(), [0, *ends][: len(ends)], ends, strict=True))


def _packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes()


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    part = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEY_BITS // 8)
    whole = np.zeros((len(part), 8), np.uint8)
    whole[:, : KEY_BITS // 8] = part
    return whole.view("<u8").ravel()


def _ask(buckets: int):
    """First question of a chunk: its different anchors and how many contents each has, up to 255."""

    def ask(chunk: pa.Table) -> pa.Table:
        data, offsets = raw(strings(chunk.column("text"), lower=False))
        keys, starts, counts = pieces(data, offsets)
        ends = starts + counts + LENGTH - 1
        content = np.zeros(len(keys), np.uint64)
        for at in (starts, starts + 16, ends - 16, ends - 8):  # a hash of the rims tells contents well enough for a count
            eight = np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(np.uint64).ravel() if len(at) else content
            content = mix(content ^ eight)
        order = np.lexsort((content, keys))
        k, c = keys[order], content[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        first = np.flatnonzero(new)
        pairs = new.copy()
        pairs[1:] |= c[1:] != c[:-1]
        total = np.diff(np.append(first, len(k)))
        different = np.add.reduceat(pairs.astype(np.int64), first) if len(first) else total
        # 1: once in the chunk; from 2 on: repeated, with that many contents and one more
        value = np.where(total == 1, 1, np.minimum(different + 1, 255)).astype(np.uint8)
        k = k[first]
        number = chunk.column("chunk")[0].as_py()
        return _table(ASKED, [(b, number, _packed(k[lo:hi]), value[lo:hi].tobytes()) for b, lo, hi in _buckets(k, buckets)])

    return ask


def _answer_anchors(asked: pa.Table) -> pa.Table:
    """One bit an anchor for: it occurs more than once; another for: its contents are too many for one task."""
    blobs = asked.column("keys").to_pylist()
    keys, value = _unpacked(blobs), np.frombuffer(b"".join(asked.column("counts").to_pylist()), np.uint8).astype(np.int64)
    _, place = np.unique(keys, return_inverse=True)
    shared = (np.bincount(place, weights=value) > 1)[place]
    hot = (np.bincount(place, weights=np.maximum(value - 2, 0)) > HOT)[place]
    out, lo = [], 0
    for chunk, bucket, blob in zip(asked.column("chunk").to_pylist(), asked.column("bucket").to_pylist(), blobs, strict=True):
        hi = lo + len(blob) // (KEY_BITS // 8)
        out.append((chunk, bucket, 0, hi - lo, np.packbits(shared[lo:hi]).tobytes(), np.packbits(hot[lo:hi]).tobytes()))
        lo = hi
    return _table(SHARED, out)


class _Chunk:
    """A chunk's repeated pieces, and the different entries it asks about: pieces, or single strings of hot anchors."""

    def __init__(self, chunk: pa.Table, answers: pa.Table):
        self.data, self.offsets = raw(strings(chunk.column("text"), lower=False))
        self.ids = chunk.column("doc_id").combine_chunks()
        self.docs = self.ids.fill_null(LAST).to_numpy()
        keys, starts, counts = pieces(self.data, self.offsets)
        known = np.sort(keys)  # faster than numpy's unique, which hashes
        known = known[np.concatenate((np.ones(min(1, len(known)), bool), known[1:] != known[:-1]))]
        rows = sorted((r for r in answers.to_pylist() if r["kind"] == 0), key=lambda r: r["bucket"])
        bits = lambda name: np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(r[name], np.uint8))[: r["n"]].astype(bool) for r in rows]])
        shared, hot = bits("first"), bits("second")
        if len(shared) != len(known):
            raise ValueError(f"{len(shared)} answers to {len(known)} anchors: the chunk's texts changed between steps")
        place = np.searchsorted(known, keys)
        take = shared[place] if len(known) else np.zeros(0, bool)
        keys, self.starts, self.counts, hot = keys[take], starts[take], counts[take], hot[place[take]]
        doc = self.docs[np.searchsorted(self.offsets, self.starts, side="right") - 1]
        rows_ = _matrix(self.data, self.starts, self.counts + LENGTH - 1)
        order, content = _same(keys, rows_, self.counts)
        first = np.flatnonzero(np.diff(content, prepend=-1))
        self.content = np.empty(len(order), np.int64)
        self.content[order] = content
        lowest = np.minimum.reduceat(doc[order], first) if len(first) else doc
        rep = order[first]
        self.rep_counts, self.rep_hot = self.counts[rep], hot[rep]
        # hot anchors: every string of a content is an entry, under a key of its own
        h = np.flatnonzero(self.rep_hot)
        reps = self.rep_counts[h]
        nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        single = _matrix(self.data, np.repeat(self.starts[rep[h]], reps) + nth, np.full(len(nth), LENGTH))
        own = np.zeros(len(nth), np.uint64)
        for i, column in enumerate(single.view(np.uint64).T[: -(-LENGTH // 8)]):
            own = mix(own ^ (column * _odd[i]))
        plain = np.flatnonzero(~self.rep_hot)
        e_keys = np.concatenate([keys[rep[plain]], own >> np.uint64(64 - KEY_BITS)])
        e_rows = np.concatenate([rows_[rep[plain]], single])
        e_counts = np.concatenate([self.rep_counts[plain], np.ones(len(nth), np.int64)])
        e_docs = np.concatenate([lowest[plain], np.repeat(lowest[h], reps)])
        order, entry = _same(e_keys, e_rows, e_counts)
        first = np.flatnonzero(np.diff(entry, prepend=-1))
        number = np.empty(len(order), np.int64)
        number[order] = entry
        self.keys, self.rows, self.sizes = e_keys[order[first]], e_rows[order[first]], e_counts[order[first]]
        self.lowest = np.minimum.reduceat(e_docs[order], first) if len(first) else e_docs
        # the entry of each string of each content
        self.at = np.cumsum(self.rep_counts) - self.rep_counts
        self.entry = np.empty(int(self.rep_counts.sum()), np.int64)
        self.nth = np.arange(len(self.entry)) - np.repeat(self.at, self.rep_counts)
        hot_string = np.repeat(self.rep_hot, self.rep_counts)
        self.entry[~hot_string] = np.repeat(number[: len(plain)], self.rep_counts[plain])
        self.entry[hot_string] = number[len(plain) :]
        self.nth[hot_string] = 0


def _ask_pieces(buckets: int):
    """Second question: each different entry with the chunk's smallest document that holds it."""

    def ask(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows:
            return _table(PIECES, [])
        number, c = chunk.column("chunk")[0].as_py(), _Chunk(chunk, answers)
        sizes = c.sizes + LENGTH - 1
        kept = c.rows[np.arange(WIDTH) < sizes[:, None]]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return _table(PIECES, [(b, number, _packed(c.keys[lo:hi]), c.sizes[lo:hi].astype(np.uint8).tobytes(), kept[ends[lo] : ends[hi]].tobytes(), c.lowest[lo:hi].tobytes()) for b, lo, hi in _buckets(c.keys, buckets)])

    return ask


def _ordered(bwt: np.ndarray) -> np.ndarray:
    """Places by symbol and place."""
    if bwt.dtype != np.uint8 or len(bwt) >> 24:
        return np.argsort(bwt, kind="stable")
    both = (bwt.astype(np.uint32) << np.uint32(24)) | np.arange(len(bwt), dtype=np.uint32)
    both.sort()
    return both & np.uint32((1 << 24) - 1)


def sorted_collection(rows: np.ndarray, sizes: np.ndarray, limit: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, common prefix with the suffix before, up to ``limit``) of all suffixes, in order.

    ``rows`` holds a string a row. Round j inserts the j-th symbol from the end of every string at once:
    where the suffix that it extends stands, the symbol's place among equal symbols gives the place of
    the new suffix, and the smallest common prefix since the last equal symbol, plus one, the new one's.
    One pass over the transform of the round before makes the next.
    """
    m = len(rows)
    column = np.arange(rows.shape[1])
    symbols = np.unique(rows[column < sizes[:, None]])
    kind = np.uint8 if len(symbols) < 256 else np.uint16
    ranked = (np.searchsorted(symbols, rows) + 1).astype(kind)  # 0 ends a string
    longest = int(sizes.max(initial=0))
    reverse = sizes[:, None] - 1 - np.arange(longest)
    by_round = np.zeros((longest + 1, m), kind)
    by_round[:longest] = np.where(reverse >= 0, np.take_along_axis(ranked, np.maximum(reverse, 0), 1), 0).T
    bwt, lcp, suffix = by_round[0].copy(), np.zeros(m, np.uint8), np.arange(m, dtype=np.int32 if m < 1 << 23 else np.int64) << 8
    last = np.arange(m)  # places of the suffixes of the round before
    for j in range(1, longest + 1):
        n = len(bwt)
        order = _ordered(bwt)
        ended = n - np.count_nonzero(bwt)
        fresh = np.zeros(n, bool)
        fresh[last] = bwt[last] != 0
        k = np.flatnonzero(fresh[order])
        last = order[k].astype(np.int64)
        down = np.argsort(-last)  # from the back, so that reduceat reads no more than the ranges
        k, last = k[down], last[down]
        if not len(last):
            break
        symbol, string = bwt[last], suffix[last] >> 8
        before, after = (order[np.clip(k + d, 0, n - 1)].astype(np.int64) for d in (-1, 1))
        has_before, has_after = (k > 0) & (bwt[before] == symbol), (k < n - 1) & (bwt[after] == symbol)
        padded = np.append(lcp, np.uint8(0))
        lowest = lambda lo, hi: np.minimum.reduceat(padded, np.stack([lo, hi], 1).ravel())[::2]
        own = np.where(has_before, np.minimum(lowest(np.where(has_before, before + 1, last), last + 1) + 1, limit), 0)
        next_ = np.minimum(lowest(np.minimum(last + 1, n - 1), np.where(has_after, after + 1, np.minimum(last + 2, n))) + 1, limit)
        at = m - ended + k
        old = np.ones(n + len(at), bool)
        old[at] = False
        grown = []
        for held, new in ((bwt, by_round[j][string]), (lcp, own), (suffix, (string << 8) + j)):
            whole = np.empty(len(old), held.dtype)
            whole[old] = held
            whole[at] = new
            grown.append(whole)
        bwt, lcp, suffix = grown
        lcp[at[has_after] + 1] = next_[has_after]
        last = np.flatnonzero(~old)
    string = suffix >> 8
    return string, sizes[string] - (suffix & 255), lcp


def _answer_pieces(asked: pa.Table) -> pa.Table:
    """For each entry, runs of its strings with the smallest document that holds them."""
    chunks, buckets = asked.column("chunk").to_pylist(), asked.column("bucket").to_pylist()
    blobs = asked.column("keys").to_pylist()
    keys = _unpacked(blobs)
    counts = np.frombuffer(b"".join(asked.column("sizes").to_pylist()), np.uint8).astype(np.int64)
    docs = np.frombuffer(b"".join(asked.column("docs").to_pylist()), np.int64)
    sizes = counts + LENGTH - 1
    data = np.frombuffer(b"".join(asked.column("bytes").to_pylist()), np.uint8)
    rows = np.zeros((len(keys), WIDTH), np.uint8)
    rows[np.arange(WIDTH) < sizes[:, None]] = data
    order, content = _same(keys, rows, counts)
    first = np.flatnonzero(np.diff(content, prepend=-1))
    rep, lowest = order[first], np.minimum.reduceat(docs[order], first)
    keys, rows, counts = keys[rep], rows[rep], counts[rep]
    # smallest document of each string of each content: that of the content, unless another content of the anchor has it
    at = np.cumsum(counts) - counts
    found = np.repeat(lowest, counts)
    group = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    members = np.diff(np.append(group, len(keys)))
    several = np.flatnonzero(np.repeat(members > 1, members))
    lo = 0
    while lo < len(several):
        hi = min(lo + COLLECTION, len(several))
        while hi < len(several) and keys[several[hi]] == keys[several[hi - 1]]:
            hi += 1
        part = several[lo:hi]
        string, start, common = sorted_collection(rows[part], counts[part] + LENGTH - 1)
        whole = start < counts[part][string]  # at least LENGTH bytes follow
        same = np.cumsum(common < LENGTH)[whole]
        runs = np.flatnonzero(np.diff(same, prepend=-1))
        owner = part[string[whole]]
        least = np.repeat(np.minimum.reduceat(lowest[owner], runs), np.diff(np.append(runs, len(same))))
        found[at[owner] + start[whole]] = least
        lo = hi
    # runs of strings with one document
    edge = np.ones(len(found), bool)
    edge[1:] = found[1:] != found[:-1]
    edge[at] = True
    begins = np.flatnonzero(edge)
    length, value = np.diff(np.append(begins, len(found))), found[begins]
    run_first = np.searchsorted(begins, at)
    n_runs = np.diff(np.append(run_first, len(begins)))
    back = np.empty(len(order), np.int64)
    back[order] = content
    out, lo = [], 0
    for chunk, bucket, blob in zip(chunks, buckets, blobs, strict=True):
        hi = lo + len(blob) // (KEY_BITS // 8)
        c = back[lo:hi]
        picked = np.arange(n_runs[c].sum()) + np.repeat(run_first[c] - (np.cumsum(n_runs[c]) - n_runs[c]), n_runs[c])
        out.append((chunk, bucket, 1, hi - lo, length[picked].astype(np.uint8).tobytes(), value[picked].tobytes()))
        lo = hi
    return _table(SHARED, out)


def _removed(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """What is left of every text of a chunk."""
    if answers.num_rows:
        c = _Chunk(chunk, answers)
        rows = sorted((r for r in answers.to_pylist() if r["kind"] == 1), key=lambda r: r["bucket"])
        length = np.frombuffer(b"".join(r["first"] for r in rows), np.uint8).astype(np.int64)
        least = np.repeat(np.frombuffer(b"".join(r["second"] for r in rows), np.int64), length)  # by string of each entry
        entry_at = np.cumsum(c.sizes) - c.sizes
        of_content = least[entry_at[c.entry] + c.nth]
        reps = c.counts
        nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        doc = np.repeat(c.docs[np.searchsorted(c.offsets, c.starts, side="right") - 1], reps)
        gone = of_content[np.repeat(c.at[c.content], reps) + nth] < doc
        places = (np.repeat(c.starts, reps) + nth)[gone]
        data, offsets, ids = c.data, c.offsets, c.ids
    else:
        data, offsets = raw(strings(chunk.column("text"), lower=False))
        places, ids = np.zeros(0, np.int64), chunk.column("doc_id").combine_chunks()
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + LENGTH, -1)
    covered = np.cumsum(cover[:-1], dtype=np.int32) > 0
    opens = covered.copy()
    opens[1:] &= ~covered[:-1]
    opens[offsets[:-1][offsets[:-1] < len(data)]] |= covered[offsets[:-1][offsets[:-1] < len(data)]]
    removed = np.concatenate(([0], np.cumsum(covered)))
    spans = np.concatenate(([0], np.cumsum(opens)))
    kept = data[~covered].tobytes()
    left = offsets - removed[offsets]
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
    whole = lambda x: pa.array(np.diff(x[offsets]).astype(np.int64))
    return pa.table([ids, pa.array(np.diff(offsets)), whole(removed), whole(spans), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (removed runs), kept_sha256 (of the bytes left).

    A byte goes if a string of 50 bytes over it also starts in a row with a smaller identifier; strings
    are judged on the whole input. Null text is empty, null identifiers count as larger than any other,
    and rows that share an identifier do not remove each other's text (so repeated rows give equal
    results). Texts below 50 bytes stay whole. An empty table gives an empty result; other columns are
    not read. Texts are written once and not shuffled; memory is that of a chunk (CHUNK_BYTES, or one
    longer text) or of a bucket of anchors. An anchor with thousands of different surroundings is
    dealt out string by string; one that every chunk holds costs a row of about 80 bytes a chunk.
    """
    spark = docs.sparkSession
    store = Scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = store.bucketed(rows.mapInArrow(_chunked, CHUNKED), "repeat-texts", "chunk", parts)
    total = table.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(parts, int(total) // (LENGTH * BUCKET_KEYS // 4))
    chunks = table.groupBy("chunk")
    asked = chunks.applyInArrow(_ask(buckets), ASKED)
    anchors = store.written(asked.groupBy("bucket").applyInArrow(_answer_anchors, SHARED), "repeat-anchors")
    entries = chunks.cogroup(anchors.groupBy("chunk")).applyInArrow(_ask_pieces(buckets), PIECES)
    answers = store.written(entries.groupBy("bucket").applyInArrow(_answer_pieces, SHARED), "repeat-pieces")
    result = store.written(chunks.cogroup(anchors.unionByName(answers).groupBy("chunk")).applyInArrow(_removed, RESULT), "repeat-result")
    store.clear(result)
    return result
