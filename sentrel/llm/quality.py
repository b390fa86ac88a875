"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One hashed weight vector is shared by all grades; ordered thresholds cut the latent score. The
fitted model gives each text its expected grade and the probability of reaching the top grades.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import WORD, distinct, mix, raw, slices, strings, words

BITS = 18
SAMPLE_ROWS, ROW_VALUES = 10_000, 16_384
CUT = 0.7

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEM_BYTES = 4
CAPS, REPEAT, MARKS, STEM = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x369DEA0F31A53F85)


def features(texts: pa.LargeStringArray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document, value): presence of words and stems, shares of capitals, repetition and marks.

    Words, their first bytes and runs of marks are hashed; three more features hold the share of words in capitals, of
    words equal to the one before, and of marks by kind. Shares are counted as ten times their
    square root, so that a few odd words in a long text still show.
    """
    n = len(texts)
    cased, offsets = raw(texts)
    low = np.where((cased >= 65) & (cased <= 90), cased + 32, cased).astype(np.uint8)
    h, doc, start, end, ph = words(low, offsets, prefix=STEM_BYTES)
    total = np.maximum(np.bincount(doc, minlength=n), 1)
    is_mark = ~WORD[cased] & ~SPACE[cased]
    mh, mdoc, mstart, mend = words(cased, offsets, is_mark)
    upper = np.concatenate(([0], np.cumsum((cased >= 65) & (cased <= 90))))
    caps = (upper[end] - upper[start] == end - start) & (end - start > 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    key, kdoc, _ = distinct(h, doc)
    stem, sdoc, _ = distinct(mix(ph ^ STEM), doc)
    mkey, mkdoc, count = distinct(mix(mh ^ MARKS), mdoc)
    share = lambda flag: 10 * np.sqrt(np.bincount(doc[flag], minlength=n) / total)
    every, mask = np.arange(n), (1 << bits) - 1
    bucket = np.concatenate([key.astype(np.int64) & mask, stem.astype(np.int64) & mask, mkey.astype(np.int64) & mask, np.full(n, int(CAPS) & mask), np.full(n, int(REPEAT) & mask)])
    value = np.concatenate([np.ones(len(key) + len(stem)), 10 * np.sqrt(count / (total[mkdoc] + count)), share(caps), share(same)])
    return bucket, np.concatenate([kdoc, sdoc, mkdoc, every, every]), value.astype(np.float32)


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the 0/1 marks: one point for quality, one for not being toxic (0, 1 or 2).

    Rows in which either mark is null have no grade; of repeated identifiers the lowest grade holds.
    """
    return labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")).alias("grade"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tails(latent: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > j) for every cut j."""
    return _sigmoid(latent[:, None] - thresholds[None, :])


def fit(rows: list[tuple[int, bytes, bytes]], bits: int = BITS, grades: int = 3, ridge: float = 5.0, rounds: int = 160, rate: float = 0.2, min_rows: int = 20) -> dict:
    """Maximum penalised likelihood of the cumulative logit model by full-batch Adam.

    Buckets that fewer than ``min_rows`` sampled rows fill keep weight zero.
    """
    y = np.array([r[0] for r in rows], np.int64)
    if not len(y):
        return {"bits": bits, "weights": np.zeros(1 << bits, np.float32), "thresholds": np.linspace(-2, -1, grades - 1)}
    idx = [np.frombuffer(r[1], np.int32) for r in rows]
    val = np.concatenate([np.frombuffer(r[2], np.float32) for r in rows])
    doc = np.repeat(np.arange(len(y)), [len(i) for i in idx])
    idx = np.concatenate(idx)
    common = np.bincount(idx, minlength=1 << bits)[idx] >= min(min_rows, len(y))
    idx, val, doc = idx[common], val[common], doc[common]
    used, col = np.unique(idx, return_inverse=True)
    share = np.array([(np.sum(y > j) + 0.5) / (len(y) + 1) for j in range(grades - 1)])
    cuts = -np.log(share / (1 - share))
    # thresholds: the first, then logarithms of the gaps, so that they stay ordered
    p = np.concatenate([np.zeros(len(used)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    m, v, k = np.zeros_like(p), np.zeros_like(p), len(used)
    for t in range(1, rounds + 1):
        w, theta = p[:k], np.cumsum(np.concatenate([p[k : k + 1], np.exp(p[k + 1 :])]))
        above = tails(np.bincount(doc, val * w[col], minlength=len(y)), theta)
        full = np.concatenate([np.ones((len(y), 1)), above, np.zeros((len(y), 1))], axis=1)
        row = np.arange(len(y))
        hi, lo = full[row, y], full[row, y + 1]
        mass = np.maximum(hi - lo, 1e-9)
        d_latent = -(hi * (1 - hi) - lo * (1 - lo)) / mass
        d_theta = np.array([np.sum(np.where(y == j + 1, hi * (1 - hi) / mass, 0) - np.where(y == j, lo * (1 - lo) / mass, 0)) for j in range(grades - 1)])
        g_w = np.bincount(col, val * d_latent[doc], minlength=k) + ridge * w
        g_t = np.cumsum(d_theta[::-1])[::-1]
        g = np.concatenate([g_w, g_t[:1], g_t[1:] * np.exp(p[k + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate / (1 + t / rounds * 4) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << bits, np.float32)
    weights[used] = p[:k]
    return {"bits": bits, "weights": weights, "thresholds": np.cumsum(np.concatenate([p[k : k + 1], np.exp(p[k + 1 :])]))}


def train(docs: DataFrame, grades: DataFrame, sample_rows: int = SAMPLE_ROWS, row_values: int = ROW_VALUES, bits: int = BITS, levels: int = 3, **options) -> dict:
    """Fit on at most ``sample_rows`` graded documents (the smallest hashes of the identifier).

    ``sample_rows`` rows of at most ``row_values`` different features (8 bytes each, about 4 KB in all for
    most texts) bound what the driver receives; a text with more features does not train. Of rows that
    share an identifier one trains, the text with the smallest hash. The sample does not depend on
    partitioning. Null texts count as empty. Without graded rows every weight is zero.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in slices(strings(batch.column(1), lower=False)):
                bucket, doc, value = features(piece, bits)
                order = np.argsort(doc, kind="stable")
                bucket, value, cut = bucket[order].astype(np.int32), value[order], np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(piece)))))
                cells = [(bucket[a:b].tobytes(), value[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(piece)), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["grade", "idx", "val"])

    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = named.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")).select("grade", "one.text")
    got = rows.mapInArrow(extracted, "grade int, idx binary, val binary").where(F.length("idx") <= 4 * row_values).collect()
    return fit(sorted((r.grade, bytes(r.idx), bytes(r.val)) for r in got), bits, levels, **options)


def _tail_probabilities(column: pa.Array, model: dict) -> np.ndarray:
    """P(grade > j) of every text for every cut j."""
    above = [np.zeros((0, len(model["thresholds"])))]
    for _, piece in slices(strings(column, lower=False)):
        bucket, doc, value = features(piece, model["bits"])
        above.append(tails(np.bincount(doc, value * model["weights"][bucket], minlength=len(piece)), model["thresholds"]))
    return np.concatenate(above)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, expected_grade, tail_probability, accepted for every row, from the whole text.

    ``tail_probability`` is that of the top grade; a row is accepted where it reaches ``cut``. Null
    text counts as empty. Null and repeated identifiers are scored like others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _tail_probabilities(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, -1]), pa.array(p[:, -1] >= cut)], names=["doc_id", "expected_grade", "tail_probability", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(scored, "doc_id long, expected_grade double, tail_probability double, accepted boolean")


def accepted(docs: DataFrame, model: dict, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score`` accepts; nothing is shuffled.

    Null text is judged as an empty one. Identifiers are not read: rows that repeat one, or lack it, are
    judged each by their text, so repeated rows stay or go together. A probability that equals ``cut`` is
    accepted. Whole texts count, however long. An empty table gives an empty table of the same columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_tail_probabilities(batch.column(at), shared.value)[:, -1] >= cut))

    return docs.mapInArrow(filtered, docs.schema)
