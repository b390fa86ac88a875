"""Near-duplicate classes against all pairs, and the signatures against weighted Jaccard."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sentrel.llm import near_dedup
from sentrel.llm.near_dedup import SIMILARITY, WORDS


def shingles(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i : i + WORDS]) for i in range(max(len(words) - WORDS + 1, 1))} if words else set()


def brute(rows):
    """Smallest identifier of every row's class, from all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    root = lambda i: i if label[i] == i else root(label[i])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= SIMILARITY * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in sets}


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (1, 2, 6, 30):
        base = rng.choices(vocabulary, k=120)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n := n + 1, " ".join(own)))
    chain = rng.choices(vocabulary, k=100)
    for i in range(12):  # neighbours are alike, ends are not
        chain = list(chain)
        chain[i * 8] = "changed"
        rows.append((n := n + 1, " ".join(chain)))
    same = " ".join(rng.choices(vocabulary, k=50))
    rows += [(n := n + 1, same) for _ in range(40)] + [(n := n + 1, same.upper() + "!")]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows += [(n := n + 1, passage + " " + " ".join(rng.choices(vocabulary, k=60))) for _ in range(25)]
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "..."), (n + 4, "one two"), (n + 5, "One, two"), (n + 6, "one"), (n + 7, " ".join(vocabulary) * 40)]
    return rows


def test_classes_equal_all_pairs(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 0, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, class_id string, key int, node int, own int, t1 int, _id int").repartition(3)
    got = {r.doc_id: r for r in near_dedup.near_classes(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(table).collect()}
    assert got == brute([(r.doc_id, r.text) for r in table.collect()])


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "x y z u v w"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.kept) for r in near_dedup.near_classes(df).collect()), key=str)
    assert got == sorted([(None, 4, False), (None, None, True), (4, 4, True), (4, 4, True), (None, None, True)], key=str)
    assert sorted(map(str, near_dedup.deduplicated(df).collect())) == sorted(map(str, [df.collect()[i] for i in (1, 2, 4)]))
    assert near_dedup.deduplicated(df.where("false")).count() == 0
    assert near_dedup.near_classes(df.where("false")).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    a = {int(x): rng.uniform(0.1, 9) for x in rng.integers(1, 1 << 40, 200)}
    b = {x: (w if rng.random() < 0.8 else rng.uniform(0.1, 9)) for x, w in a.items() if rng.random() < 0.9}
    want = sum(min(a.get(x, 0), b.get(x, 0)) for x in a) / sum(max(a.get(x, 0), b.get(x, 0)) for x in a)
    got = near_dedup.signatures(np.array([*a, *b], np.uint64), np.repeat([0, 1], [len(a), len(b)]), np.array([*a.values(), *b.values()]), 2, 4096)
    assert (got != 0).all()
    assert (got[0] == got[1]).mean() == pytest.approx(want, abs=0.03)


def test_weighted_classes_use_counts(spark):
    rng = random.Random(8)
    line = " ".join(rng.choices([f"w{i}" for i in range(99)], k=12)) + " "
    rows = [(1, line * 10), (2, line * 9), (3, line * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bag = lambda t: Counter(tuple(t.split()[i : i + WORDS]) for i in range(len(t.split()) - WORDS + 1))
    assert sum((bag(rows[0][1]) & bag(rows[1][1])).values()) >= 0.8 * sum((bag(rows[0][1]) | bag(rows[1][1])).values())
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(df, weighted=True).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.class_id for r in near_dedup.near_classes(df).collect()} == {1}


def edits(n, most, seed):
    rng = random.Random(seed)
    base, rows = [f"w{i}" for i in range(140)], []
    for i in range(n):  # edits of one text: some copies link, many do not
        own = list(base)
        for _ in range(rng.randint(0, most)):
            own[rng.randrange(len(own))] = f"e{rng.random()}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("small", "block", "leaders"), [(1, 4, 1), (8, 16, 3), (1000, 4, 1)])
def test_large_buckets_by_blocks(spark, monkeypatch, small, block, leaders):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CROWD", small)
    monkeypatch.setattr(near_dedup, "LEADERS", leaders)
    rows = edits(60, 6, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 1 < len(set(want.values())) < 60
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()} == want


def test_links_of_a_crowd_are_few(spark, monkeypatch):
    rows, counts = edits(400, 5, 9), []
    plain = near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda links, store=None: counts.append(links.count()) or plain(links, store))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(df).collect()} == brute(rows)
    assert sum(counts) < 24 * 400  # all pairs would be 79,800


def test_repeated_identifiers(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(3, t, "a"), (5, t + " x", "b"), (5, "a text of another kind with ten words in it", "c"), (None, t, "d"), (3, t + " y", "e"), (3, t, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    kept = near_dedup.deduplicated(df).collect()
    assert len(kept) == 2 and {(r.doc_id, r.text) for r in kept} < {(3, t), (3, t + " y"), (5, rows[2][1])} and (5, rows[2][1]) in {(r.doc_id, r.text) for r in kept}


def test_overlaps_and_forest():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(20)]
    near_dedup.PRODUCT, whole = 7, near_dedup.PRODUCT
    got = near_dedup._overlaps([s.tobytes() for s in sets[:8]], [s.tobytes() for s in sets[8:]], False)
    near_dedup.PRODUCT = whole
    want = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets[8:]] for a in sets[:8]]
    assert np.allclose(got, want)
    near = rng.random((8, 12)) < 0.15
    left, right = np.arange(8), np.arange(8, 20)
    groups = lambda links: {frozenset(c) for c in _closure(links, range(20))}
    links = near_dedup.spanning(near, left, right)
    assert groups(links) == groups([(i, 8 + j) for i, j in zip(*np.nonzero(near))]) and len(links) == 20 - len(groups(links))


def _closure(links, nodes):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return [[n for n in nodes if label[n] == v] for v in set(label.values())]
