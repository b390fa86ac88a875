"""Importance resampling of documents towards a target distribution of hashed n-grams.

Texts above CHUNK_BYTES are cut at word boundaries into overlapping chunks: a chunk owns the n-grams
that start in it and carries the n - 1 words that the last of them need. Chunks of a long text are
rows of their own, dealt over all tasks, and their counts and weights are summed by document. Texts
are read once; what is kept of them is the list of their features' buckets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.operators.order import placed

from ._store import Scratch

CHUNK_BYTES = 256 << 10
#: A word after A-Z are lower-cased: ASCII digits and letters and everything that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

CHUNK = "key long, doc_id long, piece binary, carry int"
FEATURES = "key long, doc_id long, n_words long, buckets array<int>"


def chunks(text: bytes, n: int, size: int = CHUNK_BYTES) -> Iterator[tuple[bytes, int]]:
    """(bytes, carried words) of each chunk of a lower-cased text.

    A chunk ends with the first word that reaches ``size`` bytes, however long that word is, and is
    followed by the next n - 1 words, fewer at the end of the text. Each word is owned by one chunk.
    """
    start = end = 0
    carry: list[tuple[int, int]] = []  # words behind the chunk's end
    for word in WORD.finditer(text):
        if end - start >= size:
            carry.append(word.span())
            if len(carry) < n:
                continue
            # carry now holds the n - 1 words to carry and one more, or, for n = 1, just the next word
            last = carry[n - 2][1] if n > 1 else end
            yield text[start:last], n - 1
            start, end = carry[0][0], carry[0][1]
            rest, carry = carry[1:], []
            for span in rest:
                if end - start >= size:
                    carry.append(span)
                else:
                    end = span[1]
            continue
        end = word.end()
    if carry:  # the text ends within what the last full chunk carries
        yield text[start : carry[-1][1]], len(carry)
        start, end = carry[0][0], carry[-1][1]
    if end > start:
        yield text[start:end], 0


def features(piece: bytes, carry: int, n: int, buckets: int) -> tuple[int, list[int]]:
    """(owned words, bucket of every n-gram of 1 to n words that starts at one of them) of a lower-cased piece."""
    words = WORD.findall(piece)
    owned = len(words) - carry
    crc = zlib.crc32
    out = [crc(w) % buckets for w in words[:owned]]
    for k in range(2, n + 1):
        out += [crc(b" ".join(words[i : i + k])) % buckets for i in range(min(owned, len(words) - k + 1))]
    return owned, out


def _cut(n: int):
    """Rows of long texts to rows of chunks, keyed by task and row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for piece, carry in chunks(text.cast(pa.binary()).as_py().lower(), n):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([doc_id.as_py()], pa.int64()), pa.array([piece], pa.binary()), pa.array([carry], pa.int32())], names=["key", "doc_id", "piece", "carry"])
                key += 1

    return cut


def _counted(n: int, buckets: int):
    """Words and buckets of every row (key, doc_id, piece, carry), a few megabytes at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lo, size = [], 0, 0
            pieces = batch.column(2).cast(pa.large_binary())
            for i in range(batch.num_rows):
                piece = pieces[i].as_py() or b""
                owned, out = features(piece.lower(), batch.column(3)[i].as_py(), n, buckets)
                found.append((owned, np.array(out, np.int32)))
                size += len(piece)
                if size >= CHUNK_BYTES * 8 or i == batch.num_rows - 1:
                    offsets = np.concatenate(([0], np.cumsum([len(b) for _, b in found]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([b for _, b in found])))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(found)), batch.column(1).slice(lo, len(found)), pa.array([w for w, _ in found], pa.int64()), lists], names=["key", "doc_id", "n_words", "buckets"])
                    found, lo, size = [], i + 1, 0

    return count


def _weighed(gains: np.ndarray):
    """Sum of the gains of every row's buckets."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            sums = np.concatenate(([0], np.cumsum(gains[lists.flatten().to_numpy()])))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ends[1:] - ends[:-1]), pa.array(sums[ends[1:]] - sums[ends[:-1]])], names=["key", "doc_id", "n_words", "n_features", "weight"])

    return weigh


def noise(doc_id: Column, seed: int) -> Column:
    """A document's Gumbel noise in thousandths, drawn from its identifier."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _features(rows: DataFrame, n: int, buckets: int, store: Scratch, name: str) -> DataFrame:
    """key, doc_id, n_words and buckets of every row of (doc_id, text); chunks of long texts share a key, other keys are null."""
    long = F.octet_length("text") > CHUNK_BYTES
    cut = store.written(rows.where(long).mapInArrow(_cut(n), CHUNK), f"{name}-chunks")
    dealt = cut.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", F.xxhash64("piece"))
    short = rows.where(~long).select(F.lit(None).cast("long").alias("key"), "doc_id", F.col("text").cast("binary").alias("piece"), F.lit(0).alias("carry"))
    return store.written(short.unionByName(dealt).mapInArrow(_counted(n, buckets), FEATURES), f"{name}-features")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 2, buckets: int = 10_000, least_words: int = 20, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank.

    Features are the runs of 1 to ``n`` words, hashed into ``buckets``. A bucket's gain is the floor of
    1000 ln of its smoothed share in ``target`` over that in ``docs``; weights sum the gains of all
    features, repeats included. Of the rows with ``least_words`` words, ``percent`` of 100 with the
    highest score (weight plus noise by identifier and seed) are drawn and ranked from 1; ties go to
    the smaller identifier, null last. Other rows have a null rank.

    Null text has no words; an empty table counts nothing. Repeated rows are rows of their own: equal
    scores at different ranks, so the edge of the draw can part them. Other columns are not read.
    The driver receives two counts a bucket.
    """
    store = Scratch(docs.sparkSession)
    text = lambda df, c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text")
    own = _features(docs.select(F.col(id_col).cast("long").alias("doc_id"), text(docs, text_col)), n, buckets, store, "resample")
    other = _features(target.select(F.lit(None).cast("long").alias("doc_id"), text(target, target_col)), n, buckets, store, "resample-target")
    counts = [np.zeros(buckets), np.zeros(buckets)]
    for count, table in zip(counts, (own, other), strict=True):
        for r in table.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():
            count[r[0]] = r[1]
    (s, t), total_s, total_t = counts, counts[0].sum(), counts[1].sum()
    gains = np.floor(1000 * np.log((t + 1) * (total_s + buckets) / ((s + 1) * (total_t + buckets)))).astype(np.int64)
    weighed = own.mapInArrow(_weighed(gains), "key long, doc_id long, n_words long, n_features long, weight long")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    whole = weighed.where("key is null").drop("key").unionByName(weighed.where("key is not null").groupBy("key", "doc_id").agg(*sums).drop("key"))
    scored = store.written(whole.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    eligible = F.col("n_words") >= least_words
    drawn = scored.where(eligible).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = placed(scored.where(eligible), [], order, store, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    result = store.written(ranked.select(*columns).unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")).select(*columns)), "resample-result")
    store.clear(result)
    return result
