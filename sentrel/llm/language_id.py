"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import CHUNK_BYTES, mix, slices, strings

BUCKETS = 1 << 15
ORDERS = (2, 3)
PIECE_CHARS = 1 << 20

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(texts: pa.LargeStringArray, orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of every n-gram of lower-case letters and gaps, and letters per document.

    Runs of anything but letters count as one gap; each text starts and ends with a gap.
    """
    joined = np.frombuffer("\n".join(["", *texts.to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts.to_pylist()), np.int64, len(texts))
    # the separator after text i belongs to text i; the gap before a text is the last one kept
    doc = np.repeat(np.arange(len(texts) + 1), np.append(1, lengths + 1)) - 1
    letter = _letter_table()[joined]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    code, doc, letter = np.where(letter, joined, 32)[keep].astype(np.uint64), doc[keep], letter[keep]
    out, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in orders:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, np.uint64(n))
        some = np.zeros(m, bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + code[j : j + m]
            some |= letter[j : j + m]
        # a gram may begin at the gap that closes the text before
        own = np.maximum(doc[n - 1 :], 0)
        inside = some & ((doc[:m] == own) | (doc[min(1, n - 1) : m + min(1, n - 1)] == own))
        out.append((mix(h[inside]) & np.uint64(buckets - 1)).astype(np.int64))
        docs.append(own[inside])
    count = np.bincount(doc[letter], minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(docs), count


def pieces(text: str, orders: tuple[int, ...], buckets: int, size: int = PIECE_CHARS) -> Iterator[tuple[np.ndarray, int]]:
    """``grams`` of one text a piece at a time, so that memory does not grow with it: (buckets, letters) of each piece.

    A piece starts with the end of the one before, and counts the grams that end in it.
    """
    context, after_letter, longest = np.array([32], np.uint64), False, max(orders)
    for at in range(0, len(text) + 1, size):
        part = np.frombuffer((text[at : at + size] + ("\n" if at + size > len(text) else "")).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letter_table()[part]
        keep = letter | np.concatenate(([after_letter], letter[:-1]))[: len(part)]
        code = np.concatenate((context, np.where(letter, part, 32)[keep].astype(np.uint64)))
        some, out = code != 32, [np.zeros(0, np.int64)]
        for n in orders:
            m = len(code) - n + 1
            first = max(len(context) - n + 1, 0)
            if m > first:
                h, any_letter = np.full(m - first, np.uint64(n)), np.zeros(m - first, bool)
                for j in range(n):
                    h = h * np.uint64(0x100000001B3) + code[first + j : m + j]
                    any_letter |= some[first + j : m + j]
                out.append((mix(h[any_letter]) & np.uint64(buckets - 1)).astype(np.int64))
        yield np.concatenate(out), int(letter.sum())
        context, after_letter = code[-(longest - 1) :] if longest > 1 else code[:0], bool(letter[-1]) if len(letter) else after_letter


def _pieced(texts: pa.LargeStringArray, orders: tuple[int, ...], buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, bucket, document, letters) of slices of texts; a very long text comes in several."""
    for at, part in slices(texts):
        if len(part) == 1 and part.nbytes > CHUNK_BYTES:
            for bucket, letters in pieces(part[0].as_py(), orders, buckets):
                yield at, 1, bucket, np.zeros(len(bucket), np.int64), np.array([letters])
        else:
            yield at, len(part), *grams(part, orders, buckets)


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: CRC-32 of the identifier as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, smoothing: float = 0.5) -> dict:
    """Fit on columns text and lang: log-probabilities for each language and bucket.

    Counts cover every row given. Each task sends at most one row for a language and bucket, so the
    shuffle and the matrix (languages x buckets, 256 KB a language) do not grow with the corpus.
    Rows with null text or lang teach nothing.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = strings(batch.column(0)), batch.column(1).to_pylist()
            seen = -1
            for at, rows, bucket, doc, _ in _pieced(texts, orders, buckets):
                mine = langs[at : at + rows]
                names = sorted(set(mine))
                code = np.array([names.index(x) for x in mine])
                table = np.bincount(code[doc] * buckets + bucket, minlength=len(names) * buckets).reshape(len(names), buckets)
                for i, x in enumerate(names):
                    total = sums.setdefault(x, np.zeros(buckets + 1, np.int64))
                    total[:-1] += table[i]
                    total[-1] += int((code == i).sum()) * (at > seen)
                seen = at
        for x, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    parts = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null").mapInArrow(counted, "lang string, bucket long, n long")
    got = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(got.lang.unique())
    code = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), buckets + 1))
    counts[got.lang.map(code).to_numpy(int), got.bucket.to_numpy(int)] = got.n.to_numpy(float)
    docs, counts = counts[:, -1], counts[:, :-1] + smoothing
    with np.errstate(divide="ignore"):
        return {"langs": names, "prior": np.log(docs / max(docs.sum(), 1)), "logp": np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy(), "orders": orders, "buckets": buckets}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior probability) for every row, from the whole text alone.

    Texts that are null or have no letter get ``und`` and score 0, and so does everything where the
    model has learned no language. Ties go to the language that sorts first. Rows with null or
    repeated identifiers are scored like others; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n, langs = batch.num_rows, len(m["langs"])
            total, letters = np.zeros((n, langs)), np.zeros(n, np.int64)
            for at, rows, bucket, doc, held in _pieced(strings(batch.column(1)), m["orders"], m["buckets"]):
                letters[at : at + rows] += held
                for k in range(langs):  # sparse counts of each document times the matrix, one language at a time
                    total[at : at + rows, k] += np.bincount(doc, m["logp"][bucket, k], minlength=rows)
            total += m["prior"]
            if langs:
                best = total.argmax(axis=1)
                post = np.where(letters > 0, 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
            else:
                letters, best, post = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            names = [m["langs"][b] if some else "und" for b, some in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(post)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(scored, "doc_id long, lang_pred string, score double")
