"""Aligned tokens against a plain walk over whole texts."""

import functools
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from sentrel.llm import alignment as al

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def models():
    a = tokenizers.Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def whole(text):
    """(A ids, B ids, groups, links) of one text, tokenized whole; None without tokens."""
    a, b = models()
    if not text:
        return None
    chars = al.byte_level()
    ours = a.encode(" " + text, add_special_tokens=False).ids
    theirs = b.encode(text)
    bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ours]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in theirs]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    stops = []
    for parts in (bytes_a, bytes_b):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        stops.append(out)
    groups, ga, gb, i, j = [], [], [], 0, 0
    while i < len(ours) or j < len(theirs):
        if j == len(theirs) or (i < len(ours) and stops[0][i] <= stops[1][j]):
            ga.append(ours[i])
            i += 1
        else:
            gb.append(theirs[j])
            j += 1
        if i and j and stops[0][i - 1] == stops[1][j - 1]:
            groups.append((ga, gb))
            ga, gb = [], []
    links = [(x, y) for x, s in zip(ours, stops[0], strict=True) for y, t in zip(theirs, stops[1], strict=True) if s == t] if len(ours) < 400 else [(g[0][-1], g[1][-1]) for g in groups]
    return ours, theirs, groups, links


def brute(rows):
    found = [(d, whole(t)) for d, t in rows]
    counts = Counter(x for _, w in found if w for x in w[3])
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for d, w in found:
        if not w:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in w[2])
        out.append((d, len(w[0]), len(w[1]), len(w[2]), len(w[3]), sum(counts[x] == most[x[1]] for x in w[3]), sum(counts[x] for x in w[3]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(11)
    words = ["the", "Tokenization", "naïve", "日本語", "🙂", "don't", "x=1;", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "...", "ﬁ", "12345", " ", "a b", "\x1c", "ﬃ", "İ"]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\n", "\t", ""]) for _ in range(k))
    rows = [(i, text(r.randint(1, 60))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "   "), (104, "▁"), (105, "a ▁b c"), (106, " lead"), (107, "trail "), (108, "\n"), (109, "a" * 500), (None, rows[1][1]), rows[2], rows[2], (110, "\x00 b"), (111, text(3000))]
    return rows


@pytest.mark.parametrize("memo", [al.MEMO_UNITS, 3])
def test_equals_whole_texts(spark, memo):
    rows = corpus()
    found = al.align(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, PIECE, memo_units=memo)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(x) for x in found.select(*columns).collect()), key=repr) == brute(rows)


def test_possible_pairs_are_bounded_by_the_vocabularies():
    words = al.Vocabularies(BYTE, PIECE)
    assert words.split
    assert len(words.pairs) <= 2 * sum(map(len, [*words.bytes_a.values(), *words.bytes_b.values()]))
    assert (words.pairs[1:] > words.pairs[:-1]).all()


def test_odd_tables(spark):
    assert al.align(spark.createDataFrame([], "doc_id long, text string"), BYTE, PIECE).count() == 0
    clash = spark.createDataFrame([(1, "a b", 3, [4])], "id long, body string, kind int, links array<int>")
    row = al.align(clash, BYTE, PIECE, "id", "body").first()
    assert (row.doc_id, row.n_a, row.n_b, row.n_groups) == (1, 2, 2, 2)
