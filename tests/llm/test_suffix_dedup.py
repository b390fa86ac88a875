"""Repeated passages against brute force, and the sorted collection against sorting."""

import hashlib
import random

import numpy as np
import pytest

from sentrel.llm import suffix_dedup as sd


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, digest) of every row, from all strings of 50 bytes."""
    data = [(d, (t or "").encode()) for d, t in rows]
    rank = lambda d: sd.LAST if d is None else d
    least = {}
    for d, t in data:
        for i in range(len(t) - 49):
            s = t[i : i + 50]
            least[s] = min(least.get(s, sd.LAST), rank(d))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < rank(d):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in sd.remove_repeats(docs).collect()), key=repr)


def corpus(seed, n=120):
    """Texts with shared passages, near and exact copies, periods, short and empty texts, repeated rows."""
    r = random.Random(seed)
    words = ["ba", "né", "tion", "the", "re", "quo", "x", "日本", "ing"]
    text = lambda k: " ".join("".join(r.choices(words, k=r.randint(1, 4))) for _ in range(k))
    shared = [text(r.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(r.randint(0, 30))] + [x for _ in range(r.randint(0, 3)) for x in (r.choice(shared)[r.randint(0, 9) :], text(r.randint(0, 6)))]
        rows.append((r.randint(0, 3 * n), r.choice(["", " ", "\n"]).join(parts)))
    rows += [(r.randint(0, 3 * n), rows[5][1]) for _ in range(8)] + [rows[9], rows[9]]
    for i in range(20):  # near copies
        t = list(rows[7][1])
        t[r.randrange(len(t))] = "#"
        rows.append((1000 + i, "".join(t)))
    rows += [(5000, "=" * 400), (5001, "ab" * 300 + "=" * 70), (5002, "ab" * 26), (5003, None), (5004, ""), (None, rows[7][1]), (None, shared[0]), (5005, "=" * 49)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_small_chunks_blocks_and_hot_anchors(spark, monkeypatch):
    """The limits of memory change nothing in the result, nor does dealing anchors out string by string."""
    rows = corpus(3)
    for name, value in (("CHUNK_BYTES", 3000), ("BLOCK", 128), ("HOT", 1), ("COLLECTION", 4), ("BUCKET_KEYS", 64)):
        monkeypatch.setattr(sd, name, value)
    tables = [sd._chunked, sd._answer_anchors, sd._answer_pieces, sd._removed]
    assert tables and local(rows) == brute(rows)


def local(rows):
    """All steps in this process, where the limits are patched."""
    import pyarrow as pa

    chunks, size = [[]], 0
    for row in rows:
        if size > sd.CHUNK_BYTES:
            chunks.append([])
            size = 0
        chunks[-1].append(row)
        size += len((row[1] or "").encode())
    tables = [pa.table({"chunk": [i] * len(c), "doc_id": pa.array([d for d, _ in c], pa.int64()), "text": [t or "" for _, t in c]}) for i, c in enumerate(chunks)]

    def by(parts, column):
        whole = pa.concat_tables(parts)
        return {v: whole.filter(pa.compute.equal(whole[column], v)) for v in set(whole[column].to_pylist())}

    buckets = 7
    anchors = by([sd._answer_anchors(g) for g in by([sd._ask(buckets)(t) for t in tables], "bucket").values()], "chunk")
    assert any(any(np.unpackbits(np.frombuffer(r["second"], np.uint8))) for a in anchors.values() for r in a.to_pylist())
    none = next(iter(anchors.values())).slice(0, 0)
    asked = [sd._ask_pieces(buckets)(t, anchors.get(i, none)) for i, t in enumerate(tables)]
    pieces = by([sd._answer_pieces(g) for g in by(asked, "bucket").values()], "chunk")
    out = [sd._removed(t, pa.concat_tables([anchors.get(i, none), pieces.get(i, none)])) for i, t in enumerate(tables)]
    return sorted((tuple(r.values()) for t in out for r in t.to_pylist()), key=repr)


def test_sorted_collection_is_the_sorted_suffixes():
    r = random.Random(5)
    for alphabet, top in ((b"ab", 76), (bytes(range(256)), 60), (b"a", 20)):
        texts = [bytes(r.choices(alphabet, k=r.randint(1, top))) for _ in range(60)] + [b"aaaa", b"aaaa"]
        sizes = np.array([len(t) for t in texts])
        rows = np.zeros((len(texts), sd.WIDTH), np.uint8)
        for i, t in enumerate(texts):
            rows[i, : len(t)] = np.frombuffer(t, np.uint8)
        string, start, common = sd.sorted_collection(rows, sizes)
        suffixes = [texts[s][a:] for s, a in zip(string, start, strict=True)]
        assert len(suffixes) == sum(sizes) + len(texts)
        assert suffixes == sorted(suffixes)
        for a, b, c in zip(suffixes, suffixes[1:], common[1:], strict=False):
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert c == min(same, sd.LENGTH)


def test_odd_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), (1, "short")]) == brute([(None, None), (1, "short")])
    docs = spark.createDataFrame([(1, "x" * 60, "a", 5), (2, "x" * 60, "b", 6)], "doc_id long, text string, chunk string, bucket int")
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in sd.remove_repeats(docs).collect()} == {1: (0, 0), 2: (60, 1)}
    renamed = docs.select(docs.doc_id.alias("chunk"), docs.text.alias("keys"))
    assert sorted(r.n_removed for r in sd.remove_repeats(renamed, "chunk", "keys").collect()) == [0, 60]


def test_a_very_long_text(spark):
    passage = "".join(random.Random(1).choices("abcdefghij ", k=30_000))
    long = "".join(random.Random(2).choices("abcdefghij ", k=9_000_000))
    rows = [(1, long), (2, "front " + long[5_000_000:5_030_000] + passage), (3, passage + "y" + long[:100])]
    by_id = {r.doc_id: r for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by_id[1].n_removed == 0 and by_id[2].n_removed == 30_000 and by_id[3].n_removed == 30_100 and by_id[3].n_spans == 2
