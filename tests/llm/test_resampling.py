"""Importance resampling against a plain count of every n-gram."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from sentrel.llm import resampling as rs


def grams(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, percent, n, buckets, least, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, n)[1]) for texts in ([x for _, x in docs], target))
    size, want = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (want + buckets))))
    rows = []
    for d, x in docs:
        words, found = grams(x, n)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in found)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    ranked = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(ranked) * percent // 100
    out = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(ranked)] + [(*r[:4], None) for r in rows if r[4] < least]
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    words = ["Alpha", "beta", "ÉTÉ", "日本語", "x1", "THE", "of", "z" * 40]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", "  ", "-", "\n", "\x7f"]) for _ in range(k))
    docs = [(i * 3 % 101, text(r.randint(0, 60))) for i in range(80)]
    return docs + [(500, None), (501, ""), (502, "..."), (None, text(30)), docs[3], docs[3], (503, text(700)), (504, "w" * 3000), (505, "w" * 3000 + " " + text(400))], [text(25) for _ in range(6)] + [None]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_equals_plain_count(spark, n):
    docs, target = corpus(n)
    found = rs.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), 30, n, 97, 20, 7)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == brute(docs, target, 30, n, 97, 20, 7)


@pytest.mark.parametrize("size", [1, 5, 64, 1000])
def test_chunks_own_each_feature_once(size):
    docs, _ = corpus(9)
    for n in (1, 2, 3, 5):
        for _, text in docs:
            lower = (text or "").encode().lower()
            whole = rs.features(lower, 0, n, 10_000)
            parts = [rs.features(piece, carry, n, 10_000) for piece, carry in rs.chunks(lower, n, size)]
            assert sum(p[0] for p in parts) == whole[0]
            assert sorted(b for p in parts for b in p[1]) == sorted(whole[1])


def test_long_texts_are_chunk_rows(spark):
    """A text of several chunks has one row, with the sums of its chunks."""
    r = random.Random(4)
    long = " ".join(f"w{r.randint(0, 300)}" for _ in range(200_000))
    docs, target = [(1, long), (2, "w1 w2 " * 15), (2, long), (3, "w3 " * 30)], ["w3 w4 w5"]
    found = rs.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, target[0])], "item_id long, text string"), 50, 2, 1000, 20, 1)
    assert len(long.encode()) > 3 * rs.CHUNK_BYTES
    assert sorted((tuple(x) for x in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == brute(docs, target, 50, 2, 1000, 20, 1)


def test_odd_tables(spark):
    empty, none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rs.resample(empty, none).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 1, "k")], "doc_id long, text string, rank int, key string")
    row = rs.resample(clash, none, 100, 1, 10, 1).first()
    assert (row.doc_id, row.n_features, row["rank"]) == (1, 3, 1)
