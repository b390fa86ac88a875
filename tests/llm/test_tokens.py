"""Packing and SentencePiece against the tokenizer libraries and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from sentrel.llm import packing, sentencepiece_codec
from sentrel.llm.queries import PIECE_MODEL, byte_tokenizer

TEXTS = [
    "The quick brown fox. It's 42!", None, "", " ", "  two  spaces ", "tab\there \n\nlines\n end ", "nbsp  and wide", "naïve façade ß 日本語 🎉",
    "<|endoftext|> in text", "▁mark ▁▁", "x" * 3000, "word " * 2500, "The quick brown fox. It's 42!", "a\r\nb \x0b c\x1f d", "it 's we'LL ̀ é",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["alpha", "beta,", "Gamma", "delta.", "ünd", "7", "in"]
    rows = [(i, t, "other") for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 900))), "x") for i in range(60)] + [(None, "no name", None), (3, " ", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)


def test_every_id_is_packed_once(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, byte_tokenizer()).collect()
    rows, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        rows[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for row in docs.collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(rows[row.doc_id], key=lambda p: p.start)
        assert all(p.doc_tokens == len(ids) for p in own)
        if row.doc_id == 3:  # repeated
            continue
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == len(ids)
        assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own]
    assert len(rows[3]) == 2
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        total = sum(p.length for p in own)
        assert total <= 1024 and total & (total - 1) == 0


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), byte_tokenizer()).count() == 0


def test_neighbours_are_the_best_by_bm25():
    rng = random.Random(1)
    cells = [np.array([rng.randint(1, 40) for _ in range(rng.randint(1, 60))] + [0], "<u2").tobytes() for _ in range(50)]
    ids = [np.frombuffer(c, "<u2") for c in cells]
    holding = np.bincount(np.concatenate([np.unique(i) for i in ids]), minlength=1 << 16)
    tokens = sum(map(len, ids))
    index = packing.Index(cells, holding, 50, tokens)
    idf = {t: np.log1p((50 - holding[t] + 0.5) / (holding[t] + 0.5)) for t in range(41)}
    impact = lambda d, t: idf[t] * (n := int((ids[d] == t).sum())) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ids[d]) / (tokens / 50)))
    unused = np.ones(50, bool)
    unused[[0, 7, 9]] = False
    score = {d: sum(impact(d, t) for t in set(ids[0].tolist())) for d in range(50) if unused[d]}
    want = sorted((d for d in score if score[d] > 0), key=lambda d: (-round(score[d], 9), d))[:10]
    assert [round(score[d], 9) for d in index.neighbours(0, unused, 10)] == [round(score[d], 9) for d in want]


def test_windows_take_every_neighbour_before_a_fresh_seed():
    """Sixty short texts of each of two kinds, interleaved: the first window takes all of one kind."""
    cells = [np.array([1 + i % 2, 3 + i % 2, 0], "<u2").tobytes() for i in range(120)]
    holding = np.bincount(np.concatenate([np.frombuffer(c, "<u2") for c in cells]), minlength=1 << 16).astype(float)
    holding[0] = 120.5
    order = [p[0] for p in packing._layout([3] * 120, packing.Index(cells, holding, 120, 360), 1024)]
    assert [d % 2 for d in order] == [0] * 60 + [1] * 60


def plain_layout(ids, impact, window):
    """Greedy windows by the definition: a seed, its best unused neighbours while there are any, else the next unused in order."""
    unused, pieces, number, offset, queue = list(range(len(ids))), [], 0, 0, []
    while unused:
        queue = [d for d in queue if d in unused]
        doc, seeded = (queue[0], False) if queue and offset else (unused[0], True)
        unused.remove(doc)
        start = 0
        while start < len(ids[doc]):
            take = min(window - offset, len(ids[doc]) - start)
            pieces.append((doc, start, take, number, offset))
            start, offset = start + take, offset + take
            if offset == window:
                number, offset, seeded = number + 1, 0, True
        if seeded and offset:
            score = {d: sum(impact(d, t) for t in set(ids[doc])) for d in unused}
            queue = sorted((d for d in unused if score[d] > 1e-12), key=lambda d: (-round(score[d], 9), d))
    return pieces


@pytest.mark.parametrize("vocabulary", [64, 70_000])
def test_layout_equals_plain_greedy_windows(vocabulary):
    rng = random.Random(2)
    ids = [[rng.randint(1, 40) for _ in range(rng.choice([1, 3, 10, 60, 150]))] + [0] for _ in range(60)]
    cells = [np.array(i, f"<u{packing.width(vocabulary)}").tobytes() for i in ids]
    holding = np.bincount(np.concatenate([np.unique(i) for i in ids]), minlength=vocabulary).astype(float)
    holding[0] = 60.5
    total = sum(map(len, ids))
    impact = lambda d, t: np.log1p((60 - holding[t] + 0.5) / (holding[t] + 0.5)) * (n := ids[d].count(t)) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ids[d]) / (total / 60)))
    got = list(packing._layout([len(i) for i in ids], packing.Index(cells, holding, 60, total), 128))
    assert got == plain_layout(ids, impact, 128)
    tail = packing._tail(got, 128)
    assert sum(p[2] for p in tail) == total and tail[: len(got) - 9] == got[: len(got) - 9]


def test_place_is_the_set_of_strongest_terms():
    rng = random.Random(8)
    ids = [[rng.randint(1, 50) for _ in range(rng.randint(0, 30))] + [0] for _ in range(80)]
    holding = np.array([0.0, *[rng.choice([1, 5, 300, 900]) for _ in range(63)]])
    holding[0] = 1000.5
    total = sum(map(len, ids))
    keys = packing._keys([np.array(i, "<u2").tobytes() for i in ids], holding, 1000, total)
    for own, key in zip(ids, keys, strict=True):
        score = {t: np.log1p((1000 - holding[t] + 0.5) / (holding[t] + 0.5)) * (n := own.count(t)) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / max(total / 1000, 1))) for t in set(own) if t and holding[t] > 1}
        best = sorted(score, key=lambda t: (holding[t] < packing.SKETCH_HOLDING, -score[t], t))[:3]
        assert sorted([*best, 0, 0, 0][:3]) == [int(key) >> shift & 0xFFFF for shift in (15, 31, 47)]


def test_all_terms_of_a_seed_score():
    """A seed of twenty terms finds a text that shares only its weakest one."""
    cells = [np.array([*range(1, 21), 0], "<u2").tobytes(), np.array([20, 20, 0], "<u2").tobytes(), np.array([99, 0], "<u2").tobytes()]
    holding = np.full(1 << 16, 2.0)
    holding[[0, 20]] = 1000.5, 900
    assert packing.Index(cells, holding, 1000, 9000).neighbours(0, np.array([False, True, True])) == [1]


def test_copies_far_apart_in_the_file_share_a_window(spark):
    """Texts whose copies are 1,500 rows away, in another run of 1,024 rows: the ids' order brings most together."""
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=25)) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string").coalesce(1)
    held = defaultdict(set)
    for r in packing.pack(docs, byte_tokenizer()).collect():
        held[r.doc_id].add(r.sequence_id)
    assert len(held) == 3000
    assert np.mean([bool(held[i] & held[i + 1500]) for i in range(1500)]) > 0.9


def brute(vocab, text):
    """Best total over all segmentations, by trying every piece at every position."""
    pieces = {p.replace("▁", " "): (i, s) for i, (p, s, k) in enumerate(zip(vocab["pieces"], vocab["scores"], vocab["kinds"], strict=True)) if k == "text"}
    worst = min(s for _, s in pieces.values() if s > -1e8) - 10
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = [best[end - n] + pieces[text[end - n : end]][1] for n in range(1, min(end, 20) + 1) if text[end - n : end] in pieces]
        best.append(max(options + ([best[-1] + worst] if text[end - 1] not in pieces else [])))
    return best[-1], worst


def test_pieces_score_best_and_texts_come_back(spark, docs):
    path = public_tokenizers.path(PIECE_MODEL)
    vocab = sentencepiece_codec.vocabulary(path)
    encoded = sentencepiece_codec.encode(docs, path)
    for row in sentencepiece_codec.decode(encoded, path).collect():
        assert row.decoded == (row.text or "")
        if row.text and len(row.text) < 400:
            best, worst = brute(vocab, " " + row.text)
            kinds = [vocab["kinds"][i] for i in row.ids]
            data = bytes(int(vocab["pieces"][i][3:5], 16) for i, k in zip(row.ids, kinds, strict=True) if k == "byte")
            total = sum(vocab["scores"][i] for i, k in zip(row.ids, kinds, strict=True) if k == "text") + worst * len(data.decode())
            assert total == pytest.approx(best)
        if not row.text:
            assert row.ids == []
    assert sentencepiece_codec.encode(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_decode_replaces_a_column_of_its_name(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepiece_codec.encode(spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string"), path)
    found = sentencepiece_codec.decode(encoded.withColumn("decoded", F.lit(5)), path)
    assert found.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id, r.decoded) for r in found.where("text is not null").collect()) == [(1, "one two"), (1, "one two")]
