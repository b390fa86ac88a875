"""Chats, neighbours and the pipeline."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sentrel.llm import ann, chat_format, near_dedup, quality, queries


def chats(rows):
    """conv_id: rendered text of the maximal conversations, by comparing all lists of turns."""
    seen = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, hashlib.md5((r[3] or "").encode()).hexdigest())):
        seen.setdefault(conv, []).append((role, text))
    out = {}
    for conv, turns in seen.items():
        equal = [c for c, t in seen.items() if t == turns]
        smallest = min((c for c in equal if c is not None), default=None)
        if conv == smallest and not any(len(t) > len(turns) and t[: len(turns)] == turns for t in seen.values()):
            out[conv] = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)
    return out


def test_snapshots_collapse(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(40):
        base = rng.randint(0, 5)
        rows += [(conv, t, "user" if t % 2 == 0 else "bot", f"{base}-{t}") for t in range(rng.randint(1, 6))]
    rows += [(100, t * 7, "user", f"long {t}") for t in range(300)] + [(101, t * 7, "user", f"long {t}") for t in range(200)] + [(102, t * 7, "user", f"long {t}" if t else "other") for t in range(5)]
    rows += [(200, None, None, None), (200, 1, None, ""), (201, 1, "", None), (None, 1, "user", "no name"), (202, 1, "u", "same"), (202, 1, "u", "same"), (203, 1, "u", "same"), (204, 1, "u", ""), (204, 2, "u", "é" * 50_000)]
    df = spark.createDataFrame([(*r, 1, 2, True, 3) for r in rows], "conv_id long, turn long, role string, text string, pos int, cid int, none boolean, h1 int").repartition(5)
    got = {}
    for r in chat_format.format_chats(df).collect():
        got.setdefault(r.conv_id, {})[r.part] = r.rendered
    assert {c: "".join(p[i] for i in sorted(p)) for c, p in got.items()} == chats(rows)
    assert len(got[100]) == 5
    assert chat_format.format_chats(df.where("false")).count() == 0


@pytest.mark.parametrize("turn", [None, 7, "own"])
def test_hot_conversations(spark, monkeypatch, turn):
    """One conversation without a name and a copy of it with one, longer by a turn, with one turn number or many."""
    monkeypatch.setattr(chat_format, "HOT_TURNS", 500)
    rng = random.Random(1)
    body = [(i if turn == "own" else turn, "user", f"{rng.randint(0, 99)} x") for i in range(3000)]
    last = (10**6, "user", "end")
    rows = [(None, *r) for r in body] + [(5, *r) for r in [*body, last]] + [(6, *r) for r in [*body, last]] + [(9, 1, "a", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {}
    for r in chat_format.format_chats(df).collect():
        got.setdefault(r.conv_id, {})[r.part] = r
    assert {c: "".join(p[i].rendered for i in sorted(p)) for c, p in got.items()} == chats(rows)
    assert set(got) == {5, 9} and {r.copies for r in got[5].values()} == {2} and len(got[5]) == 47


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    df = queries.op4_chat_format(spark, "/root/testdata/sf0.001")
    want = con.sql(queries.ORACLE["op4_chat_format"])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def test_chat_plan_has_no_python(spark):
    df = queries.op4_chat_format(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    x = np.concatenate([rng.normal(size=(500, 16)), centre + 0.05 * rng.normal(size=(300, 16)), np.tile(centre, (200, 1))]).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int").repartition(6)


def exact(x, i, k):
    d = x.astype(float)
    score = (d @ d[i]) / np.sqrt((d * d).sum(1)) / np.sqrt(d[i] @ d[i])
    score[i] = -9
    return np.lexsort((np.arange(len(x)), -np.round(score, 12)))[:k], score


def test_recall_order_and_scores(vectors):
    x, df = vectors
    rows = {}
    for r in ann.nearest(df, df.where("vec_id % 10 = 0"), 5).collect():
        rows.setdefault(r.query_id, []).append(r)
    assert set(rows) == set(range(0, 1000, 10))
    hits = []
    for i, own in rows.items():
        own.sort(key=lambda r: r.rank)
        want, score = exact(x, i, 5)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and i not in [r.vec_id for r in own]
        assert [r.score for r in own] == pytest.approx([score[r.vec_id] for r in own], abs=1e-12)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(own, own[1:], strict=False))
        hits.append(len({r.vec_id for r in own} & set(want.tolist())) / 5)
    assert np.mean(hits) >= 0.9
    assert [r.vec_id for r in sorted(rows[900], key=lambda r: r.rank)] == [800, 801, 802, 803, 804]


def test_search_of_everything_is_exact(vectors):
    x, df = vectors
    got = {}
    for r in ann.nearest(df, df.where("vec_id in (0, 7, 600)"), 3, share=1.0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    assert {i: [g[1], g[2], g[3]] for i, g in got.items()} == {i: exact(x, i, 3)[0].tolist() for i in (0, 7, 600)}


def test_many_blocks_and_a_queue_in_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    rows = ann.nearest(df, df.where("vec_id % 9 = 0"), 4, share=0.7).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r["rank"]] = r
    # the same search without Spark: leaves in the queue's order, then every vector in them
    forest = ann.grow(x[np.argsort(rng.random(900))], 900)
    leaves = ann.route(forest, x)
    sizes = ann.leaf_sizes(leaves, forest["levels"])
    assert (sizes.sum(axis=1) == 900).all()
    order = [(t, leaf, held) for t, leaf, held in ann.visits(forest, sizes, x[3])]
    assert len(order) == len({o[:2] for o in order}) == ann.TREES << forest["levels"] and order[-1][2] == pytest.approx(1)
    unit = x[3] / np.sqrt(x[3] @ x[3])

    def miss(t, leaf):  # sum of squares over the planes that the leaf lies beyond
        node, total = 1, 0.0
        for level in range(forest["levels"]):
            side = (leaf >> (forest["levels"] - 1 - level)) & 1
            gap = forest["planes"][t][level] @ unit - forest["cuts"][t, node]
            total += gap * gap * (side != (gap > 0))
            node = 2 * node + side
        return total

    costs = [miss(t, leaf) for t, leaf, _ in order]
    assert costs == pytest.approx(sorted(costs))
    assert [held for *_, held in order] == sorted(held for *_, held in order)
    hits = [len({r.vec_id for r in own.values()} & set(exact(x, i, 4)[0].tolist())) / 4 for i, own in got.items()]
    assert len(got) == 100 and np.mean(hits) > 0.9
    reached = np.array([t * (2 << forest["levels"]) + leaf for t, leaf, _ in order[:9]])
    block = ann.Block([v.tobytes() for v in x], [[i] for i in range(900)], "<f8", forest)
    assert set(block.candidates(reached).tolist()) == {i for i in range(900) for t, leaf, _ in order[:9] if leaves[i, t] == leaf}


def test_other_lengths_and_extreme_vectors(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e199]), (3, [1e-300, 1e-300]), (4, [0.0, 5e-324]), (5, [1.0, 2.0]), (6, [1.0, 2.0, 3.0]), (7, [3.0, 2.0, 1.0]), (8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df, 9, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and len(got[1]) == 4
    assert sorted(got[6]) == [(1, 7, round(10 / 14, 9))] and sorted(got[4])[0] == (1, 5, round(2 / 5**0.5, 9)) and sorted(got[1])[0] == (1, 2, round(1 / 1.01**0.5, 9))


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (None, [1.0, 1.0]), (10, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, df, 5).collect())
    assert got == [(1, 1, 2), (1, 2, 10), (2, 1, 1), (2, 2, 10), (10, 1, 2), (10, 2, 1)]
    assert ann.nearest(df.where("false"), df, 5).count() == 0 == ann.nearest(df, df.where("false"), 5).count()


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    ids = [{r.doc_id for r in df.select("doc_id").distinct().collect()} for df in kept]
    assert all(df.columns == columns for df in kept[:-1])
    assert ids[0] > ids[1] > ids[2] >= ids[3] == ids[4] == ids[5]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len({texts[i] for i in ids[1]}) == len({texts[i] for i in ids[2]}) == len(ids[2])
    assert ids[2] == {max(i for i in ids[1] if texts[i] == t) for t in {texts[i] for i in ids[1]}}
    classes = near_dedup.near_classes(kept[2]).collect()
    assert ids[3] == {r.class_id for r in classes}
    assert all("[SECRET" in r.text or r.text == texts[r.doc_id] for r in kept[4].collect())
    assert {r.doc_id: sum(p.length for p in kept[5].where(f"doc_id = {r.doc_id}").collect()) for r in kept[4].limit(3).collect()} == {r.doc_id: kept[5].where(f"doc_id = {r.doc_id}").first().doc_tokens for r in kept[4].limit(3).collect()}
    assert sorted(corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()) == sorted(kept[5].select("doc_id").distinct().collect())


def plain_shingles(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_pipeline_of_odd_rows(spark, tmp_path, monkeypatch):
    """Nulls, empty and long texts, repeated identifiers, copies and clashing columns, against plain rules; then an empty table."""
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["stone", "river", "green", "house", "under", "light", "paper", "winter", "small", "early"]) + str(rng.randint(0, 9)) for _ in range(n))
    base = prose(60)
    rows = [(1, base), (2, base), (2, prose(40)), (3, base + " end"), (None, prose(30)), (None, base), (4, None), (5, ""), (5, ""), (6, prose(30_000)), (7, f"{prose(20)} api_key = 'x9Kd82LmQpZ4vT7cW1bN' {prose(5)}"), (8, "?!")]
    own = [(i, t, "en", "src", 0, n, -n, f"k{n}", f"one {n}", None, n, bool(n % 2)) for n, (i, t) in enumerate(rows)]
    table = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, _id int, id int, _key string, _t1 string, t2 int, node int, kept boolean")
    for name, df in (("some", table), ("none", table.where("false"))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (1, None, 0), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    monkeypatch.setattr(quality, "CUT", 0.0)
    monkeypatch.setattr(quality.accepted, "__defaults__", ("text", 0.0))
    docs, kept = spark.read.parquet(str(tmp_path / "some" / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path / "some"))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    assert all(df.columns == table.columns for df in kept[:-1])
    assert kept[0].count() == len(rows)
    # what stays keeps the values of all columns, whatever their names; only secrets change a text and its length
    assert all(tuple(r) in set(own) for df in kept[:3] for r in df.collect()) and all(df.dtypes == table.dtypes for df in kept[:-1])
    assert {tuple(r)[5:] for r in kept[3].collect()} <= {r[5:] for r in own}
    # the largest identifier of each text, null last
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    exact_kept = {(max((i for i in ids if i is not None), default=None), t) for t, ids in texts.items()}
    assert {(r.doc_id, r.text or "") for r in kept[1].collect()} == exact_kept and kept[1].count() == len(exact_kept)
    # the smallest identifier of near-duplicates
    near = set(exact_kept)
    for a in exact_kept:
        for b in exact_kept:
            x, y = plain_shingles(a[1]), plain_shingles(b[1])
            if a != b and x and y and len(x & y) >= 0.8 * len(x | y) and b[0] is not None and (a[0] is None or b[0] < a[0]):
                near.discard(a)
    assert {(r.doc_id, r.text or "") for r in kept[2].collect()} == near
    clean = {r.doc_id: r for r in kept[3].collect() if r.doc_id}
    assert "[SECRET:assignment]" in clean[7].text and clean[7].n_chars == len(clean[7].text) and kept[3].count() == kept[2].count()
    ids = {i: sorted((p.start, p.length) for p in kept[4].collect() if p.doc_id == i) for i in clean if i != 2}  # two rows share 2
    assert all(own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) for own in ids.values())
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
