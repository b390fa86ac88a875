"""Packing by lexical retrieval.

Documents are dealt by a sketch of their strongest terms, so that likely neighbours meet. Neighbours
in that order form a shard with a BM25 inverted index of its own; the statistics behind the scores
cover the corpus. Each window starts with a seed document and asks the
index for unused neighbours, which fill it greedily; the last is cut at the window's end and its
rest seeds the next window. What a shard has left at the end is laid out in sequences whose lengths
are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._store import written
from ._text import strings

WINDOW = 1024
SHARD_DOCS = 1024
SHARD_TOKENS = 2_000_000
#: Documents in all whose sketches cut the order into partitions.
CUT_SAMPLE = 200_000
#: A sketch term occurs in this many documents at least, where a document has such terms: rarer ones gather too few.
SKETCH_HOLDING = 256
#: From so many documents of a shard on, a term counts as crowded.
CROWDED = 24
#: Crowded terms that are multiplied at a time.
PRODUCT = 2048
PART_SHARDS = 4
K1, B = 1.2, 0.75
MEMO_WORDS = 700_000
SPECIAL = "<|endoftext|>"
#: A space beside other white space, where words can't be told apart at single spaces.
GAPS = r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[tuple, Words] = {}


def width(vocabulary: int) -> int:
    """Bytes that an id takes."""
    return 2 if vocabulary <= 1 << 16 else 4


class Words:
    """Byte-level BPE ids of whole texts, with a memo of words.

    A word with the space before it is tokenised by itself, wherever it stands, as long as no other
    white space touches that space; other texts are encoded whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)
        self.memo: dict[str, bytes] = {}
        self.width = width(self.whole.get_vocab_size())
        self.code = {2: "H", 4: "I"}[self.width]
        self.end = bytes(self.width)

    def text(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids if SPECIAL in text else self.fast.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def word(self, word: str) -> bytes:
        ids = self.text(" " + word)
        if len(self.memo) < MEMO_WORDS and len(word) < 64:
            self.memo[word] = ids
        return ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        out = []
        hard = pc.or_(pc.match_substring_regex(texts, GAPS), pc.match_substring(texts, SPECIAL)).to_pylist()
        for text, whole in zip(texts.to_pylist(), hard, strict=True):
            if whole or not text:
                out.append(self.text(text))
                continue
            first, *rest = text.split(" ")
            ids = list(map(self.memo.get, rest))
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                ids[at] = self.word(rest[at])
            out.append(self.text(first) + b"".join(ids) if first else b"".join(ids))
        return out


def tokenized(docs: DataFrame, tokenizer: tuple[str, str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned, two bytes each or four where the vocabulary needs them, closed by id 0) of every row; null text is empty.

    ``tokenizer`` names the tokenizer's JSON file, its ranks file and its pattern.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Words(*tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [i + _encoders[tokenizer].end for i in _encoders[tokenizer].encode(strings(part.column(1), lower=False))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(encoded, "doc_id long, ids binary")


def _distinct_terms(cells: list[bytes], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of a list of id strings, and tokens per document."""
    size = np.array([len(c) for c in cells], np.int64) // width(vocabulary)
    kind = np.uint32 if len(cells) * vocabulary < 1 << 32 else np.uint64
    ids = np.frombuffer(b"".join(cells), f"<u{width(vocabulary)}").astype(kind)
    ids += np.repeat(np.arange(len(cells), dtype=kind) * kind(vocabulary), size)
    ids.sort()
    first = np.flatnonzero(np.concatenate((ids[:1] == ids[:1], ids[1:] != ids[:-1])))
    doc, term = np.divmod(ids[first], kind(vocabulary))
    return doc.astype(np.int64), term.astype(np.int64), np.diff(np.append(first, len(ids))), size


def term_counts(tokens: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """Documents that hold each id, documents and tokens in all: as many sums as there are ids, whatever the corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, size = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                _, term, _, n = _distinct_terms(batch.column(0).slice(at, 1000).to_pylist(), vocabulary)
                total += np.bincount(term, minlength=vocabulary)
                docs, size = docs + len(n), size + int(n.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(total[at], [docs, size]))], names=["term", "n"])

    got = tokens.select("ids").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    sums = dict(zip(got.term, got.n, strict=True))
    table = np.zeros(vocabulary, np.int64)
    for t, n in sums.items():
        if t >= 0:
            table[t] = n
    return table, int(sums.get(-1, 0)), int(sums.get(-2, 0))


def _impact(term: np.ndarray, count: np.ndarray, length: np.ndarray, holding: np.ndarray, corpus_docs: int, corpus_tokens: int) -> np.ndarray:
    """BM25 score of a term that occurs ``count`` times in a text of ``length`` tokens."""
    idf = np.log1p((corpus_docs - holding + 0.5) / (holding + 0.5))
    mean = max(corpus_tokens / max(corpus_docs, 1), 1)
    return idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))


class Index:
    """BM25 inverted index of one shard: the documents that hold each term, with their scores."""

    def __init__(self, cells: list[bytes], holding: np.ndarray, corpus_docs: int, corpus_tokens: int):
        doc, self.terms, count, size = _distinct_terms(cells, len(holding))
        impact = _impact(self.terms, count, size[doc], holding, corpus_docs, corpus_tokens)
        self.n = len(cells)
        own = np.bincount(self.terms, minlength=len(holding))
        # what terms of many documents add is one matrix product; the others are looked up
        crowded = np.flatnonzero(own >= CROWDED)
        place = np.full(len(holding), -1)
        place[crowded] = np.arange(len(crowded))
        many = place[self.terms] >= 0
        self.common = np.zeros((self.n, self.n))
        for lo in range(0, len(crowded), PRODUCT):
            some = np.flatnonzero((place[self.terms] >= lo) & (place[self.terms] < lo + PRODUCT))
            weight, held = np.zeros((2, self.n, min(PRODUCT, len(crowded) - lo)))
            weight[doc[some], place[self.terms[some]] - lo] = impact[some]
            held[doc[some], place[self.terms[some]] - lo] = 1
            self.common += held @ weight.T
        rare = ~many & (own[self.terms] > 1)  # a document alone holds the others
        doc, term, impact = doc[rare], self.terms[rare], impact[rare]
        order = np.argsort(term.astype(np.uint16 if len(holding) <= 1 << 16 else np.uint32), kind="stable")
        self.docs, self.impact = doc[order], impact[order]
        self.cut = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=self.n))))
        self.terms, sizes = term, np.bincount(term, minlength=len(holding))
        self.at, self.size = np.cumsum(sizes) - sizes, sizes

    def neighbours(self, seed: int, unused: np.ndarray, most: int | None = None) -> list[int]:
        """The best ``most`` (by default all) unused documents that score above 0 for the seed's terms, best first."""
        own = self.terms[self.cut[seed] : self.cut[seed + 1]]
        a, n = self.at[own], self.size[own]
        pick = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = (self.common[seed] + np.bincount(self.docs[pick], self.impact[pick], minlength=self.n)) * unused
        able = np.flatnonzero(score > 0)
        return able[np.argsort(-score[able], kind="stable")[:most]].tolist()


def _keys(cells: list[bytes], holding: np.ndarray, corpus_docs: int, corpus_tokens: int) -> np.ndarray:
    """A 63-bit place for every document: the set of its three strongest terms, five bits of its text, ten of its row.

    The last ten let a crowd of equal documents be cut into parts.
    """
    doc, term, count, size = _distinct_terms(cells, len(holding))
    known = (holding[term] > 1) & (term > 0)
    doc, term, count = doc[known], term[known], count[known]
    score = _impact(term, count, size[doc], holding, corpus_docs, corpus_tokens)
    score -= 1e6 * (holding[term] < SKETCH_HOLDING)  # behind the others, however strong
    top = np.zeros((len(cells), 3), np.int64)
    for i in range(3):
        first = np.flatnonzero(np.concatenate((doc[:1] == doc[:1], doc[1:] != doc[:-1])))
        if len(first):
            best = np.repeat(np.maximum.reduceat(score, first), np.diff(np.append(first, len(doc))))
            won = np.flatnonzero(score == best)
            won = won[np.concatenate(([True], doc[won[1:]] != doc[won[:-1]]))]
            top[doc[won], i] = term[won] & 0xFFFF
            rest = np.ones(len(doc), bool)
            rest[won] = False
            doc, term, score = doc[rest], term[rest], score[rest]
    top.sort(axis=1)
    crc = np.array([zlib.crc32(c) & 31 for c in cells], np.int64)
    return (top[:, 2] << 47) | (top[:, 1] << 31) | (top[:, 0] << 15) | (crc << 10) | (np.arange(len(cells)) * 617 & 1023)


def gathered(tokens: DataFrame, statistics: tuple[np.ndarray, int, int]) -> DataFrame:
    """doc_id and ids, ordered by sketch: each partition holds a range of sketches, in order.

    Ranges are cut at quantiles of a sample of about 400 documents a partition, CUT_SAMPLE in all at
    most (with fewer a partition, partitions differ more in size; their shards do not). Rows are shuffled once.
    """
    _, docs, size = statistics
    parts = max(1, -(-docs // (SHARD_DOCS * PART_SHARDS)), -(-size // (SHARD_TOKENS * PART_SHARDS)))
    shared = tokens.sparkSession.sparkContext.broadcast(statistics)
    cuts = np.zeros(0, np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                key = _keys(part.column(1).to_pylist(), *shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, key, side="right").astype(np.int32)), pa.array(key), *part.columns], names=["part", "key", "doc_id", "ids"])

    schema = "part int, key long, doc_id long, ids binary"
    if parts > 1:
        sample = tokens.sample(min(1.0, min(400 * parts, CUT_SAMPLE) / docs), seed=7).mapInArrow(placed, schema).select("key").toPandas().key.to_numpy()
        if len(sample):
            cuts = np.sort(sample)[np.arange(1, parts) * len(sample) // parts]
    rows = tokens.mapInArrow(placed, schema)
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "doc_id").select("doc_id", "ids")


def _layout(size: list[int], index: Index, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) for all ids of a shard, given its documents' tokens, in order."""
    unused = np.ones(len(size), bool)
    number = offset = fresh = 0
    found: list[int] = []
    at = 0
    for _ in range(len(size)):
        while at < len(found) and not unused[found[at]]:
            at += 1
        seeds, start = not offset or at == len(found), 0
        if seeds:
            while not unused[fresh]:
                fresh += 1
        doc = fresh if seeds else found[at]
        unused[doc] = False
        while start < size[doc]:
            take = min(window - offset, size[doc] - start)
            yield doc, start, take, number, offset
            start, offset = start + take, offset + take
            if offset == window:
                number, offset, seeds = number + 1, 0, True
        if offset and seeds:
            found, at = index.neighbours(doc, unused), 0


def _tail(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """The last, partial window, cut anew into sequences whose lengths are powers of two."""
    if not pieces or pieces[-1][4] + pieces[-1][2] == window:
        return pieces
    number = pieces[-1][3]
    last = [p for p in pieces if p[3] == number]
    out, rest = pieces[: len(pieces) - len(last)], last[-1][4] + last[-1][2]
    room, offset = 1 << (rest.bit_length() - 1), 0
    for doc, start, length, _, _ in last:
        while length:
            take = min(length, room - offset)
            out.append((doc, start, take, number, offset))
            start, length, offset = start + take, length - take, offset + take
            if offset == room:
                rest, number, offset = rest - room, number + 1, 0
                room = 1 << (rest.bit_length() - 1) if rest else 1
    return out


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row is tokenised whole and closed with id 0; null text counts as empty, so it is that id
    alone. Each id lies in exactly one piece, each sequence holds ``window`` ids or a power of two,
    and offsets leave no gap. Identifiers may be null or repeat: each row is placed by itself. An
    empty table gives an empty result. The tokens are written once to the shared folder; the ids
    are shuffled once, by sketch; a shard (at most 1,024 documents and about two million ids in that
    order) bounds the memory of a task.
    """
    vocabulary = Tokenizer.from_file(tokenizer[0]).get_vocab_size()
    each = width(vocabulary)
    tokens = written(tokenized(docs, tokenizer, id_col, text_col), "packing-ids")
    holding, count, size = term_counts(tokens, vocabulary)
    holding = holding.astype(float)
    holding[0] = count + 0.5  # the closing id is everywhere and weighs nothing
    shared = docs.sparkSession.sparkContext.broadcast((holding, count, size))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
        names: list = []
        cells: list[bytes] = []
        held = 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if cells and (len(cells) == SHARD_DOCS or held + len(ids) // each > SHARD_TOKENS):
                    yield names, cells
                    names, cells, held = [], [], 0
                names.append(name)
                cells.append(ids)
                held += len(ids) // each
        if cells:
            yield names, cells

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        for names, cells in shards(batches):
            lengths = [len(c) // each for c in cells]
            pieces = _tail(list(_layout(lengths, Index(cells, *shared.value), window)), window)
            doc, start, length, number, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            wide = [np.frombuffer(c, f"<u{each}").astype("<u4").tobytes() for c in cells]
            crc = [zlib.crc32(wide[d] if n == lengths[d] else wide[d][4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.array(lengths)[doc]), pa.array(sequence + number), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += int(number[-1]) + 1

    return gathered(tokens, (holding, count, size)).mapInArrow(packed, PIECES)
