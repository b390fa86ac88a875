"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

A query searches all trees through one priority queue: the branch whose planes it misses by the
smallest sum of squares comes next, whichever tree it is in. The vectors of the leaves it reaches are
reranked exactly. How much a query looks at is calibrated on a sample. Each vector has one home, a
block, which knows its vectors' leaves in every tree; queries are sent to the blocks with the leaves
they reach. Equal vectors are stored once with their smallest identifiers, which loses nothing as ties
go to the smaller identifier.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ._store import Scratch
from ._text import mix

TREES = 32
#: Leaves are split down to so many vectors, but for the deepest level that the sample's medians support.
LEAF_VECTORS, MOST_LEVELS = 32, 10
#: Vectors from which splits come, and queries among them on which the share to look at is calibrated.
SAMPLE_VECTORS, SAMPLE_QUERIES = 16_384, 128
#: Share of the sample's neighbours that the calibrated search finds.
RECALL = 0.95
#: A block holds so many vectors at most (about); a smaller table has so many blocks.
VECTOR_BLOCK, LEAST_BLOCKS = 131_072, 32


def _valid(column: pa.Array, kind: str = "<f8") -> list[bytes | None]:
    """Each vector as floats of ``kind``, None where it is null, zero, or holds a null or non-finite component."""
    out: list[bytes | None] = []
    flat = column.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    sizes = [0 if s is None else s for s in pc.list_value_length(column).to_pylist()]
    at = 0
    for size in sizes:
        v, b = values[at : at + size], bad[at : at + size]
        with np.errstate(over="ignore", invalid="ignore"):
            ok = size and not b.any() and np.isfinite(v).all() and v.any()
        out.append((v + 0.0).astype(kind).tobytes() if ok else None)
        at += size
    return out


def distinct_vectors(rows: DataFrame, most: int, kind: str = "<f8") -> DataFrame:
    """key (the vector's bytes), ids (its ``most`` smallest identifiers): one row per different vector.

    Each task reduces its own rows first, so a vector that many rows share arrives as a few
    identifiers a task.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(set(v))[:most] for v in held.values()], pa.list_(pa.int64()))], names=["key", "ids"])
        for batch in batches:
            for key, name in zip(_valid(batch.column(1), kind), batch.column(0).to_pylist(), strict=True):
                if key is not None and name is not None:
                    own = held.setdefault(key, [])
                    own.append(name)
                    if len(own) > 4 * most:
                        held[key] = sorted(set(own))[:most]
            if len(held) > 50_000:
                yield packed()
                held.clear()
        yield packed()

    parts = rows.mapInArrow(reduced, "key binary, ids array<long>")
    return parts.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


def keyed_rows(rows: DataFrame, kind: str = "<f8") -> DataFrame:
    """query_id, asked (the vector's bytes) of every valid row; repeated rows appear once."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(n, k) for k, n in zip(_valid(batch.column(1), kind), batch.column(0).to_pylist(), strict=True) if k is not None and n is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["query_id", "asked"])

    return rows.mapInArrow(keyed, "query_id long, asked binary").distinct()


def _planes(rng: np.random.Generator, levels: int, size: int) -> np.ndarray:
    """A random direction for each level; as many as the space has are at right angles."""
    out = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-levels // max(size, 1)))] if size else []
    return np.concatenate([np.zeros((0, size)), *out])[:levels]


def grow(sample: np.ndarray, vectors: int, trees: int = TREES, leaf_vectors: int = LEAF_VECTORS, seed: int = 3) -> dict:
    """A forest from a sample: random directions per tree and level, a median threshold per node.

    ``MOST_LEVELS`` bounds what is broadcast, as deeper medians would come from too few sampled
    vectors; beyond that leaves grow. Nodes that no sampled vector reaches split at the level's median.
    """
    levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(vectors, 1) / leaf_vectors)))))
    rng = np.random.default_rng(seed)
    planes = np.stack([_planes(rng, levels, sample.shape[1]) for _ in range(trees)])
    cuts = np.zeros((trees, 1 << levels))
    unit = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True)) if len(sample) else sample
    for t in range(trees):
        node, at = np.ones(len(sample), np.int64), unit @ planes[t].T
        for level in range(levels):
            first = 1 << level
            order = np.argsort(node, kind="stable")
            bounds = np.searchsorted(node[order], np.arange(first, 2 * first + 1))
            spare = float(np.median(at[:, level])) if len(at) else 0.0
            for i in range(first):
                own = order[bounds[i] : bounds[i + 1]]
                cuts[t, first + i] = np.median(at[own, level]) if len(own) else spare
            node = 2 * node + (at[:, level] > cuts[t, node])
    return {"planes": planes, "cuts": cuts, "levels": levels}


def route(forest: dict, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector in each tree."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    leaves = np.ones((len(vectors), len(forest["planes"])), np.int64)
    for t, planes in enumerate(forest["planes"]):
        at = unit @ planes.T
        for level in range(forest["levels"]):
            leaves[:, t] = 2 * leaves[:, t] + (at[:, level] > forest["cuts"][t, leaves[:, t]])
    return leaves


def visits(forest: dict, sizes: np.ndarray, vector: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(tree, leaf, share of all vectors that the leaves so far are expected to hold), in the order of one priority queue over all trees.

    ``sizes`` has the vectors of every leaf; trees count as independent.
    """
    at = np.einsum("tld,d->tl", forest["planes"], vector / np.sqrt(np.dot(vector, vector))).tolist()
    cuts, levels = forest["cuts"], forest["levels"]
    heap = [(0.0, t, 1, 0) for t in range(len(at))]
    total = max(float(sizes[0].sum()), 1.0)
    missed, left = [1.0] * len(at), 1.0
    while heap:
        miss, t, node, level = heapq.heappop(heap)
        while level < levels:
            gap = at[t][level] - cuts[t, node]
            heapq.heappush(heap, (miss + gap * gap, t, 2 * node + int(gap <= 0), level + 1))
            node, level = 2 * node + int(gap > 0), level + 1
        now = max(missed[t] - sizes[t, node] / total, 0.0)
        left = left * (now / missed[t]) if missed[t] else 0.0
        missed[t] = now
        yield t, node, 1 - left


def visit(forest: dict, sizes: np.ndarray, vector: np.ndarray, share: float) -> list[tuple[int, int]]:
    """The leaves that a query looks at: until they are expected to hold ``share`` of all vectors, or to the end (share 1)."""
    out = []
    for t, leaf, held in visits(forest, sizes, vector):
        out.append((t, leaf))
        if share < 1 and held >= share:
            break
    return out


def _code(trees: int, levels: int) -> str:
    """How the number of a leaf is stored."""
    return "<u2" if trees * (2 << levels) <= 1 << 16 else "<u4"


def leaf_sizes(leaves: np.ndarray, levels: int) -> np.ndarray:
    """How many vectors each leaf of each tree holds."""
    return np.stack([np.bincount(leaves[:, t], minlength=2 << levels) for t in range(leaves.shape[1])])


def calibrated(sample: np.ndarray, forest: dict, k: int, recall: float = RECALL, queries: int = SAMPLE_QUERIES, seed: int = 5) -> float:
    """The share of vectors to look at so that ``recall`` of the sample's ``k`` nearest neighbours are found.

    Neighbours are nearer in a larger table, so they are found no later there. Without neighbours: 1.
    """
    if len(sample) < 2:
        return 1.0
    unit, leaves = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True)), route(forest, sample)
    sizes, needed = leaf_sizes(leaves, forest["levels"]), []
    for q in np.random.default_rng(seed).permutation(len(sample))[:queries]:
        score = unit @ unit[q]
        score[q] = -9
        wanted = set(np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)].tolist())
        for t, leaf, held in visits(forest, sizes, sample[q]):
            for x in [x for x in wanted if leaves[x, t] == leaf]:
                wanted.discard(x)
                needed.append(held)
            if not wanted:
                break
    return float(np.quantile(needed, recall))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Vectors of equal length, a row each, in double precision.

    Those whose squares would leave double precision are scaled by a power of two, which no cosine notices.
    """
    rows = column.to_pylist()
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(float)
    top = np.abs(x).max(axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    odd = (top > 1e140) | (top < 1e-140)
    return np.where(odd, np.ldexp(x, -np.frexp(top)[1]), x) if odd.any() else x


def _spread(keys: list[bytes], blocks: int) -> np.ndarray:
    """The home block of each vector, by a hash of its bytes."""
    width = len(keys[0]) // 4
    parts = np.frombuffer(b"".join(keys), "<u4").reshape(len(keys), width).astype(np.uint64)
    return (mix((parts * (2 * np.arange(width, dtype=np.uint64) + np.uint64(1))).sum(axis=1)) % np.uint64(blocks)).astype(np.int64)


class Block:
    """Vectors of one length with their leaves; every query looks at those in the leaves it reaches."""

    def __init__(self, keys: list[bytes], ids: list[list[int]], kind: str, forest: dict | None):
        self.x, self.ids = _matrix(pa.array(keys, pa.binary()), kind), ids
        self.rough = (self.x / np.sqrt((self.x * self.x).sum(axis=1, keepdims=True))).astype(np.float32)
        self.forest = forest
        if forest:
            leaves = route(forest, self.x)
            self.order = np.argsort(leaves, axis=0, kind="stable").T.astype(np.int32).ravel()
            self.bounds = np.concatenate(([0], np.cumsum(leaf_sizes(leaves, forest["levels"]).ravel())))

    def candidates(self, reached: np.ndarray) -> np.ndarray:
        """Vectors in the reached leaves, given as numbers tree * (2 << levels) + leaf."""
        if self.forest is None:
            return np.arange(len(self.x))
        a, n = self.bounds[reached], self.bounds[reached + 1] - self.bounds[reached]
        seen = np.zeros(len(self.x), bool)
        seen[self.order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return np.flatnonzero(seen)

    def nearest(self, q: np.ndarray, reached: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(identifiers, cosines) of the ``most`` nearest candidates."""
        at = self.candidates(reached)
        if len(at) > most:  # exact only where single precision can't tell
            score = self.rough[at] @ (q / np.sqrt(np.dot(q, q))).astype(np.float32)
            at = at[score >= np.partition(score, len(at) - most)[len(at) - most] - 1e-4]
        return rerank(self.x[at], [self.ids[i] for i in at], q, most)


def rerank(x: np.ndarray, ids: list[list[int]], q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers, cosines) of the ``most`` nearest of the vectors ``x``, in double precision, ties to the smaller identifier.

    Sums of a pair run in a fixed order, so a score does not depend on what else is compared.
    """
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0)
    score = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    name, score = np.array([n for i in ids for n in i], np.int64), np.repeat(score, [len(i) for i in ids])
    best = np.lexsort((name, -score))[:most]
    return name[best], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", share: float | None = None, recall: float = RECALL, sample: int = SAMPLE_VECTORS, trees: int = TREES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest found, nearest first.

    Score is the cosine in double precision, ties go to the smaller identifier, and a row is never
    its own neighbour. Vectors that are null, zero, or hold a null or non-finite component take no
    part, nor do rows with a null identifier. Repeated rows count once. All vectors are indexed; splits
    come from at most ``sample`` of them (the smallest hashes). A query looks at ``share`` of the
    vectors (1.0 is exact), by default the share that finds ``recall`` of the neighbours in the sample.
    Vectors of another length than most of the sample's are compared among themselves, all of them.

    A vector is sent to one block and a query once to every block, with the leaves it reaches. A task
    holds one block, and the queries stream past it.
    """
    spark, store = vectors.sparkSession, Scratch(vectors.sparkSession)
    kind = "<f4" if vectors.schema[vector_col].dataType == queries.schema[vector_col].dataType == ArrayType(FloatType()) else "<f8"
    each = np.dtype(kind).itemsize
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>"))
    stored = store.written(distinct_vectors(pick(vectors), k + 1, kind), "ann-vectors")
    named = keyed_rows(pick(queries), kind)
    named = store.written(named.groupBy("asked").agg(F.min("query_id").alias("name")).join(named, "asked"), "ann-queries")
    drawn = [np.frombuffer(bytes(r.key), kind).astype(float) for r in stored.select("key").orderBy(F.xxhash64("key"), "key").limit(sample).collect()]
    lengths = [len(v) for v in drawn]
    size = max(sorted(set(lengths)), key=lengths.count) if lengths else 0
    drawn = [v for v in drawn if len(v) == size]
    main = np.array(drawn, float).reshape(len(drawn), size)
    main = _matrix(pa.array([v.tobytes() for v in main], pa.binary()), "<f8") if len(main) else main
    counts = {r.width // each: r.n for r in stored.groupBy(F.length("key").alias("width")).agg(F.count("*").alias("n")).collect()}
    forest = grow(main, counts.get(size, 0), trees)
    forest["share"] = calibrated(main, forest, k, recall) if share is None else share
    blocks = {length: max(-(-n // VECTOR_BLOCK), LEAST_BLOCKS if length == size else 1) for length, n in counts.items()}
    shared = spark.sparkContext.broadcast(forest)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 2 << shared.value["levels"]), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += leaf_sizes(route(shared.value, _matrix(batch.column(0), kind)), shared.value["levels"])
        t, leaf = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(leaf), pa.array(total[t, leaf])], names=["tree", "leaf", "n"])

    sizes = np.zeros((trees, 2 << forest["levels"]), np.int64)
    for r in stored.where(F.length("key") == size * each).select("key").mapInArrow(counted, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r.tree, r.leaf] = r.n
    known = spark.sparkContext.broadcast(sizes)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            block = np.zeros(len(keys), np.int64)
            width = np.array([len(x) for x in keys], np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                block[at] = _spread([keys[i] for i in at], blocks[int(w) // each])
            nothing = pa.nulls(len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(width // each), pa.array(block), nothing.cast(pa.int64()), *batch.columns, nothing.cast(pa.binary())], names=["length", "block", "name", "key", "ids", "reached"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = 2 << shared.value["levels"]
        for batch in batches:
            for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                length, reached = len(key) // each, b""
                if length == size:
                    vector = _matrix(pa.array([key], pa.binary()), kind)[0]
                    reached = np.array([t * span + leaf for t, leaf in visit(shared.value, known.value, vector, shared.value["share"])], _code(trees, shared.value["levels"])).tobytes()
                n = blocks.get(length, 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, length)), pa.array(np.arange(n)), pa.array(np.full(n, name)), pa.array([key] * n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.array([reached] * n, pa.binary())], names=["length", "block", "name", "key", "ids", "reached"])

    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, ([], []), None
        for batch in batches:
            out: list[tuple] = []
            for length, number, name, key, ids, reached in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (length, number) != here:
                    here, held, block = (length, number), ([], []), None
                if name is None:  # vectors of a block come first
                    held[0].append(key)
                    held[1].append(ids)
                elif held[0]:
                    block = block or Block(*held, kind, shared.value if length == size else None)
                    found, score = block.nearest(_matrix(pa.array([key], pa.binary()), kind)[0], np.frombuffer(reached, _code(trees, shared.value["levels"])).astype(np.int64), k + 1)
                    out.append((np.full(len(found), name), found, score))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "vec_id", "score"])

    cells = "length long, block long, name long, key binary, ids array<long>, reached binary"
    asked = named.where("query_id = name").select("name", "asked")
    both = stored.select("key", "ids").mapInArrow(homes, cells).unionByName(asked.mapInArrow(searched, cells))
    hits = both.repartition("length", "block").sortWithinPartitions("length", "block", F.col("name").asc_nulls_first()).mapInArrow(reranked, "name long, vec_id long, score double")
    best = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    few = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = named.select("query_id", "name").join(few, "name").where("query_id <> vec_id")
    return pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
