"""Isolation Forest: trees grown by tasks, scored by tasks.

A tree needs only a bounded subsample (256 rows), so growing is one small task a tree; rows get their
scores where they are. Every random draw is a digest of the seed and of what is drawn for (a row, a
tree, a node of a tree), so trees depend on the rows alone, neither on partitions nor on a generator,
and SQL can grow the same ones. Nodes are numbered from 1; those below node n are 2n and 2n + 1.
Features count to nine places: values that differ in the last bits of a float are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.sources.scratch import Scratch

from .order import history_quantiles, quantiles
from .temporal import FEATURES, QUARTILES, robust_scale, scaled_by, vector_columns

TREES, SUBSAMPLE, SEED, CONTAMINATION, OFFSET = 200, 256, 42, 0.05, 0.5
#: Rows that trees draw from, trees a growing task, rows a scoring task, and rows that are scored at a time.
POOL, GROWN, SCORED, SLICE = SUBSAMPLE * 64, 25, 50_000, 2_000
MINIMUM_TRAINING_ROWS = 8
#: The prime (a pool's rows are fewer) by which a tree deals the places of a pool anew, and the decimals of a feature.
PRIME, PLACES = 2**31 - 1, 9
NODES = "tree int, node int, feature int, cut double, size long"


def path_length(n: np.ndarray | float) -> np.ndarray | float:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    big = np.maximum(n, 2)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big))


def _draws(*parts: int) -> tuple[int, int]:
    """Two draws of 32 bits."""
    digest = hashlib.md5(":".join(map(str, parts)).encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def row_hash(seed: int) -> Column:
    """60 bits of a row's key; a pool holds the rows with the smallest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "drug", "event", "quarter").cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _vector() -> list[Column]:
    return [F.round(f"scaled_{x}", PLACES).alias(f"scaled_{x}") for x in FEATURES]


def _drawn(n: int, size: int, seed: int, tree: int) -> np.ndarray:
    """Places (from 0) of the ``size`` of ``n`` rows of a pool that a tree grows from."""
    a, b = _draws(seed, tree)
    key = (np.arange(1, n + 1, dtype=np.int64) * (1 + a % (PRIME - 1)) + b) % PRIME
    return np.argsort(key)[:size]


def _grow(x: np.ndarray, seed: int, tree: int, depth: int, node: int = 1) -> list[tuple]:
    """(tree, node, feature, cut, rows) of the node for rows x and of all below; a leaf's feature is -1."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 and depth else []
    if not len(spread):
        return [(tree, node, -1, 0.0, len(x))]
    a, b = _draws(seed, tree, node)
    f = int(spread[a % len(spread)])
    low, high = float(x[:, f].min()), float(x[:, f].max())
    cut = low + (b + 0.5) / 2**32 * (high - low)
    side = x[:, f] <= cut
    return [(tree, node, f, cut, len(x)), *_grow(x[side], seed, tree, depth - 1, 2 * node), *_grow(x[~side], seed, tree, depth - 1, 2 * node + 1)]


def _levels(size: int) -> int:
    return int(np.ceil(np.log2(max(size, 2))))


def _trees(pool: np.ndarray, trees: Iterator[int] | range, seed: int) -> list[tuple]:
    size = min(SUBSAMPLE, len(pool))
    return [node for tree in trees for node in _grow(pool[_drawn(len(pool), size, seed, tree)], seed, tree, _levels(size))]


def _isolation(nodes: pd.DataFrame, size: int, x: np.ndarray) -> np.ndarray:
    """Scores of rows by all trees at once.

    Trees are laid out whole, down to the lowest level: a leaf above it passes its rows on to its first
    descendants, where its path length waits.
    """
    depth, trees = _levels(size), int(nodes.tree.max()) + 1
    feature, cut = np.zeros((trees, 2 << depth), int), np.full((trees, 2 << depth), np.inf)
    paths = np.zeros((trees, 2 << depth))
    tree, node, f = (nodes[c].to_numpy() for c in ("tree", "node", "feature"))
    inner = f >= 0
    feature[tree[inner], node[inner]], cut[tree[inner], node[inner]] = f[inner], nodes.cut.to_numpy()[inner]
    level = np.frexp(node.astype(float))[1] - 1
    paths[tree[~inner], (node << (depth - level))[~inner]] = (level + path_length(nodes["size"].to_numpy()))[~inner]
    own, out = np.arange(trees), np.zeros(len(x))
    for lo in range(0, len(x), SLICE):
        part = x[lo : lo + SLICE]
        row, at = np.arange(len(part))[:, None], np.ones((len(part), trees), int)
        for _ in range(depth):
            at = 2 * at + (part[row, feature[own, at]] > cut[own, at])
        out[lo : lo + SLICE] = paths[own, at].mean(axis=1)
    return 2.0 ** (-out / float(path_length(size)))


def grow(scaled: DataFrame, trees: int = TREES, seed: int = SEED) -> tuple[pd.DataFrame, int]:
    """(nodes of all trees, subsample size) from the rows of ``robust_scale``.

    The rows with the smallest hashes of (seed, key) are a pool, bounded whatever the table, from
    which every tree draws its own 256.
    """
    pool = scaled.select(row_hash(seed).alias("_hash"), "drug", "event", "quarter", *_vector())
    sample = pool.orderBy("_hash", "drug", "event", "quarter").limit(POOL).select(*[f"scaled_{x}" for x in FEATURES]).toPandas().to_numpy(float)
    size = min(SUBSAMPLE, len(sample))
    if size < 2:
        raise ValueError("an isolation forest needs at least two rows")
    spark = scaled.sparkSession
    shared = spark.sparkContext.broadcast(sample)

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            yield pd.DataFrame(_trees(shared.value, g.id.tolist(), seed), columns=["tree", "node", "feature", "cut", "size"])

    return spark.range(trees).mapInPandas(grown, NODES).toPandas(), size


def scores(scaled: DataFrame, forest: tuple[pd.DataFrame, int]) -> DataFrame:
    """drug, event, quarter, isolation (0 to 1; larger is more isolated)."""
    shared = scaled.sparkSession.sparkContext.broadcast(forest)
    columns = [f"scaled_{x}" for x in FEATURES]

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            yield g[["drug", "event", "quarter"]].assign(isolation=_isolation(*shared.value, g[columns].to_numpy(float)))

    return scaled.select("drug", "event", "quarter", *_vector()).mapInPandas(scored, "drug string, event string, quarter string, isolation double")


def isolation_forest(features: DataFrame, contamination: float = CONTAMINATION, trees: int = TREES, seed: int = SEED, grown: tuple[pd.DataFrame, int] | None = None, scaled: DataFrame | None = None) -> DataFrame:
    """drug, event, quarter, anomaly_score (above 0: anomaly), is_anomaly over a whole snapshot.

    The threshold is the score that about ``contamination`` of the rows exceed. Rows that
    ``robust_scale`` and a forest that ``grow`` has made of these features can be given.
    """
    store = Scratch(features.sparkSession)
    scaled = robust_scale(features) if scaled is None else scaled
    found = store.written(scores(scaled, grown or grow(scaled, trees, seed)), "forest-scores")
    cut = quantiles(found, ["isolation"], [1 - contamination]).get((), {}).get("isolation", [0.0])[0]
    score = F.col("isolation") - F.lit(cut)
    return found.select("drug", "event", "quarter", score.alias("anomaly_score"), (score > 0).alias("is_anomaly"))


def _pools(rows: DataFrame, fits: DataFrame, sizes: dict[str, int], seed: int, store: Scratch) -> DataFrame:
    """at, place and scaled features of the POOL rows before each point that have the smallest hashes.

    Rows whose hash is too large for any later point go first: the share of hashes that a history of
    its size needs, with room for chance, holds a bounded number of rows of every quarter.
    """
    spark = rows.sparkSession
    key = ["drug", "event", "quarter"]
    hashed = rows.withColumn("_hash", row_hash(seed))
    for room in (1.2, float("inf")):
        share = {at: min(1.0, room * POOL / n) for at, n in sizes.items()}
        limits = spark.createDataFrame([(at, int(s * 2**60)) for at, s in share.items()], "at string, _limit long")
        near = hashed.join(F.broadcast(limits), (F.col("quarter") < F.col("at")) & (F.col("_hash") <= F.col("_limit")))
        place = F.row_number().over(Window.partitionBy("at").orderBy("_hash", *key))
        near = near.withColumn("place", place).where(F.col("place") <= POOL).join(F.broadcast(fits), "at")
        pools = store.written(scaled_by(near, _quartiles(), "at", "place").select("at", "place", *_vector()), "forest-pools")
        if {r[0]: r[1] for r in pools.groupBy("at").count().collect()} == {at: min(POOL, n) for at, n in sizes.items()}:
            return pools
    raise AssertionError("a history has fewer rows than were counted")


def _quartiles() -> dict[str, list[Column]]:
    return {x: [F.col(f"q_{x}")[i] for i in range(3)] for x in FEATURES}


def walk_forward(features: DataFrame, minimum_rows: int = MINIMUM_TRAINING_ROWS, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """quarter, drug, event, score: each quarter scored by a forest of strictly earlier rows.

    Quarters with too little history have no rows. Scores are those of ``robust_scale``, ``grow`` and
    ``scores`` round by round, but all quarters share one job for the quartiles (of value counts), one
    for the pools, one for the trees and one for the scores. No feature row is copied for later
    quarters but the POOL that each forest draws from; pools, trees and scores stay with the tasks. The features are
    read several times: the caller writes or persists them.
    """
    spark = features.sparkSession
    store = Scratch(spark)
    names, seen, sizes, own = [f"scaled_{x}" for x in FEATURES], 0, {}, {}
    for quarter, n in sorted((r[0], r[1]) for r in features.groupBy("quarter").count().collect()):
        if seen >= max(minimum_rows, 2):
            sizes[quarter], own[quarter] = seen, n
        seen += n
    if not sizes:
        return features.select("quarter", "drug", "event", F.lit(0.0).alias("score")).where("false")
    rows = features.select("drug", "event", "quarter", *vector_columns())
    found = history_quantiles(rows, FEATURES, QUARTILES, "quarter", list(sizes))
    # one row a quarter
    fits = spark.createDataFrame([(q, n, -(-own[q] // SCORED), *[found[q][x] for x in FEATURES]) for q, n in sizes.items()], "at string, history long, blocks long, " + ", ".join(f"q_{x} array<double>" for x in FEATURES))
    pools = _pools(rows, fits, sizes, seed, store)

    def grown(key: tuple, pool: pd.DataFrame) -> pd.DataFrame:
        x = pool.sort_values("place")[names].to_numpy(float)
        nodes = _trees(x, range(int(key[1]) * GROWN, min(int(key[1] + 1) * GROWN, trees)), seed)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "size"]).assign(at=key[0], drawn=min(SUBSAMPLE, len(x)))

    tasks = pools.select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-trees // GROWN) - 1))).alias("block"))
    forests = store.written(tasks.groupBy("at", "block").applyInPandas(grown, f"at string, drawn int, {NODES}"), "forest-trees")

    def scored(part: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        found = _isolation(forest, int(forest.drawn.iloc[0]), part[names].to_numpy(float)) if len(part) else np.zeros(0)
        return part[["quarter", "drug", "event"]].assign(score=found - OFFSET)

    current = scaled_by(rows.join(F.broadcast(fits), F.col("quarter") == F.col("at")), _quartiles(), "at", "blocks")
    current = current.select("drug", "event", "quarter", "at", *_vector(), F.pmod(F.xxhash64("drug", "event"), "blocks").alias("block"))
    dealt = forests.join(F.broadcast(fits.select("at", "blocks")), "at").select(*forests.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return current.groupBy("at", "block").cogroup(dealt.groupBy("at", "block")).applyInPandas(scored, "quarter string, drug string, event string, score double")
