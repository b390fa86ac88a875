"""Near-duplicate removal: DartMinHash signatures, banded joining, exact comparison.

Darts are thrown at the plane of weight and rank: every element has its own random darts, and those
inside the region below its weight count. The earliest dart of each coordinate is the signature, so
two weighted sets agree in a coordinate with the probability of their weighted Jaccard similarity.
Work per document is about k ln k darts and one look at each element, whatever the weights.

Rows with equal sets are one node. The buckets of equal bands are joined as stars around a leader.
Crowded buckets get further leaders, each from the members that are not in the bucket's largest
component yet. Members that stay apart are compared with the rest of their bucket: pair by pair in
small buckets, and in large ones block against block. Links are between components, not members, and
a pair of blocks gives a spanning forest at most, so no step makes all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, free
from ._text import BASE, distinct, mix, raw, shingles, slices, strings, words

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
MARGIN = 4.0
#: Buckets of up to so many members are compared pair by pair, larger ones by blocks of about so many members or shingles.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 256, 1 << 20
#: Buckets of more members get ``LEADERS`` leaders, one after another, before their blocks are compared.
CROWD, LEADERS = 2048, 3
#: Columns of the matrix product that compares blocks.
PRODUCT = 8192
#: Distribution function of a Poisson variable with mean 1.
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, n + 1)) for n in range(16)])
C1, C2, C3, C4 = (np.uint64(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """DartMinHash of weighted sets given as rows (element, document, weight > 0): docs x k dart hashes.

    The weight axis is cut at 0, 1, 2, 4, ..., the rank axis into cells with one expected dart per
    segment and cell; a cell's darts come from hashes of element, segment and cell, so they are the
    same wherever the element occurs. Ranks up to (ln k + margin) / total weight are looked at, and
    further ones where a coordinate is still empty. A set without elements has zeros.
    """
    out = np.zeros(docs * k, np.uint64)
    total = np.bincount(doc, weight, minlength=docs)
    margin = MARGIN
    while len(element):
        limit = (np.log(k) + margin) / np.maximum(total, 1e-300)
        segments = np.maximum(np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
        row = np.repeat(np.arange(len(element)), segments)
        segment = np.arange(len(row)) - np.repeat(np.cumsum(segments) - segments, segments)
        width = np.where(segment > 0, 2.0 ** (segment - 1), 1.0)
        lower = np.where(segment > 0, width, 0.0)
        cells = np.ceil(limit[doc[row]] * k * width).astype(np.int64)
        which = np.repeat(np.arange(len(row)), cells)
        cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
        h = mix(element[row[which]] * C1 + segment[which].astype(np.uint64) * C2 + cell.astype(np.uint64) * C3)
        darts = np.searchsorted(POISSON, _unit(h), side="right")
        at = np.repeat(np.arange(len(which)), darts)
        number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(h[at] + (number.astype(np.uint64) + np.uint64(1)) * C4)
        src = which[at]
        rank = (cell[at] + _unit(mix(dart ^ C1))) / (k * width[src])
        owner = doc[row[src]]
        inside = (rank <= limit[owner]) & (lower[src] + width[src] * _unit(mix(dart ^ C2)) <= weight[row[src]])
        slot = owner[inside] * k + (mix(dart[inside] ^ C3) % np.uint64(k)).astype(np.int64)
        rank, dart = rank[inside], dart[inside]
        first = np.full(docs * k, np.inf)
        np.minimum.at(first, slot, rank)
        won = rank == first[slot]
        out[slot[won]] = dart[won]
        lacking = np.isinf(first.reshape(docs, k)).any(axis=1)
        again = lacking[doc]
        element, doc, weight, margin = element[again], doc[again], weight[again], margin * 2 + 4
    return out.reshape(docs, k)


def shingle_sets(texts: pa.LargeStringArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit shingle, document, count) of every document's different runs of ``size`` words."""
    h, doc, _, _ = words(*raw(texts))
    return distinct(*shingles(h, doc, size))


def _sums(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    cut = np.searchsorted(doc, np.arange(docs + 1))
    return total[cut[1:]] - total[cut[:-1]]


def described(docs: DataFrame, size: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """doc_id, t1, t2, set digest (d1, d2), n shingles, bands, and one bit of every coordinate (b1, b2)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        half = k // 2
        for batch in batches:
            for at, piece in slices(strings(batch.column(1))):
                n = len(piece)
                element, doc, count = shingle_sets(piece, size)
                weight = count.astype(float) if weighted else np.ones(len(element))
                own = mix(element + (count.astype(np.uint64) * C2 if weighted else np.uint64(0)))
                sign = signatures(element, doc, weight, n, k)
                held = np.bincount(doc, weight, minlength=n)
                key = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    key = key * np.uint64(BASE) + sign[:, r::rows]
                key = mix(key + np.arange(bands, dtype=np.uint64)[None, :] * C4).view(np.int64)
                bit = (mix(sign) & np.uint64(1)).astype(np.int64)
                pack = lambda b: b @ (np.int64(1) << np.arange(b.shape[1], dtype=np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, n) for c in (0, 2, 3)), pa.array(_sums(own, doc, n).view(np.int64)), pa.array(_sums(mix(own ^ C3), doc, n).view(np.int64)), pa.array(held.astype(np.int64)), lists, pa.array(pack(bit[:, :half])), pa.array(pack(bit[:, half:]))],
                    names=["doc_id", "t1", "t2", "d1", "d2", "n", "bands", "b1", "b2"],
                )

    return docs.mapInArrow(made, "doc_id long, t1 long, t2 long, d1 long, d2 long, n long, bands array<long>, b1 long, b2 long")


def _sets(docs: DataFrame, size: int, weighted: bool) -> DataFrame:
    """node and its sorted shingles (with counts, if weighted) as bytes, from node and text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in slices(strings(batch.column(1))):
                element, doc, count = shingle_sets(piece, size)
                cut = np.searchsorted(doc, np.arange(len(piece) + 1))
                cells = [element[a:b].tobytes() + (count[a:b].tobytes() if weighted else b"") for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(piece)), pa.array(cells, pa.binary())], names=["node", "set"])

    return docs.mapInArrow(made, "node long, set binary")


def jaccard(a: bytes, b: bytes, weighted: bool) -> float:
    """Weighted or plain Jaccard similarity of two sets from ``_sets``."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not weighted:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / max(len(x) + len(y) - both, 1)
    (x, cx), (y, cy) = np.split(x, 2), np.split(y, 2)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(cx[i], cy[j]).sum())
    return least / max(int(cx.sum() + cy.sum()) - least, 1)


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """Different (u, v) of the rows (a, b, u, v) whose nodes a and b reach the threshold, compared exactly."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [jaccard(x.as_buffer(), y.as_buffer(), weighted) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    held = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").select("u", "v", "x", "y")
    return held.mapInArrow(compared, "u long, v long").distinct()


def _overlaps(rows: list[bytes], columns: list[bytes], weighted: bool) -> np.ndarray:
    """Similarity of every set of ``rows`` with every one of ``columns``, by products of narrow matrices.

    Shingles that a single set holds can't be shared and are left out; ``PRODUCT`` of the others are
    multiplied at a time, so memory does not grow with the sets.
    """
    if weighted:
        return np.array([[jaccard(x, y, True) for y in columns] for x in rows]).reshape(len(rows), len(columns))
    sets = [np.frombuffer(x, np.uint64) for x in (*rows, *columns)]
    size = np.array([len(x) for x in sets], float)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[1:] = flat[order[1:]] != flat[order[:-1]]
    first = np.flatnonzero(new)
    shared = np.diff(np.append(first, len(flat))) > 1
    keep = np.repeat(shared, np.diff(np.append(first, len(flat))))
    owner = np.repeat(np.arange(len(sets)), size.astype(int))[order[keep]]
    place = np.cumsum(new[keep]) - 1  # in order
    both = np.zeros((len(rows), len(columns)))
    for lo in range(0, int(shared.sum()), PRODUCT):
        a, b = np.searchsorted(place, (lo, lo + PRODUCT))
        held = np.zeros((len(sets), PRODUCT), np.float32)
        held[owner[a:b], place[a:b] - lo] = 1
        both += held[: len(rows)] @ held[len(rows) :].T
    return both / np.maximum(size[: len(rows), None] + size[None, len(rows) :] - both, 1)


def spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components ``left`` (of rows) and ``right`` (of columns) as all of ``near`` would: a forest."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for i in np.flatnonzero(near.any(axis=1)):
        for other in np.unique(right[near[i]]).tolist():
            a, b = top(int(left[i])), top(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(left[i]), other))
    return out


def _block_links(apart: DataFrame, rest: DataFrame, sets: DataFrame, similarity: float, weighted: bool, store: Scratch) -> DataFrame:
    """Links (u, v) of components between members apart and the rest of their large buckets, block against block.

    Blocks hold about ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles, so a task sees two blocks at a time.
    """
    count = lambda df, name: df.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias(name))
    blocks = store.written(count(apart, "rows").join(count(rest, "columns"), "key"), "near-blocks")
    own = lambda df, mine, other: (
        df.hint("merge")
        .join(blocks, "key")
        .withColumn("mine", F.pmod(F.xxhash64("node"), mine))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    )
    one = own(apart, "rows", "columns").select("key", F.col("mine").cast("long").alias("i"), F.col("other").cast("long").alias("j"), "node", "own", F.lit(True).alias("row"))
    two = own(rest, "columns", "rows").select("key", F.col("other").cast("long").alias("i"), F.col("mine").cast("long").alias("j"), "node", "own", F.lit(False).alias("row"))
    cells = one.unionByName(two).hint("merge").join(sets, "node")

    def compared(cell: pa.Table) -> pa.Table:
        row, own, held = cell.column("row").to_numpy(), cell.column("own").to_numpy(), cell.column("set").to_pylist()
        x, y = np.flatnonzero(row), np.flatnonzero(~row)
        links: list[tuple[int, int]] = []
        if len(x) and len(y):
            near = (_overlaps([held[i] for i in x], [held[j] for j in y], weighted) >= similarity) & (own[x][:, None] != own[y][None, :])
            links = spanning(near, own[x], own[y])
        return pa.table({"u": pa.array([p[0] for p in links], pa.int64()), "v": pa.array([p[1] for p in links], pa.int64())})

    return cells.select("key", "i", "j", "own", "row", "set").groupBy("key", "i", "j").applyInArrow(compared, "u long, v long").distinct()


def components(links: DataFrame, store: Scratch | None = None) -> DataFrame:
    """node, label: the smallest node that links (u, v) connect each node with.

    Labels spread along links and then jump to their label's label until none changes. Each round
    is two joins and partial minima, so a node with many links is only a key with many rows.
    """
    store = store or Scratch(links.sparkSession)
    ends = store.written(links.select("u", "v").union(links.select("v", "u")).distinct(), "links")
    labels = ends.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("low")).select("node", F.least("low", "node").alias("label"))
    while True:
        near = ends.join(labels, F.col("u") == F.col("node")).groupBy("v").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("v")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = spread.select(F.col("node").alias("root"), F.col("label").alias("deeper"))
        jumped = store.written(spread.join(roots, F.col("label") == F.col("root")).select("node", "old", F.least("label", "deeper").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels


def _relabelled(labels: DataFrame, links: DataFrame, store: Scratch) -> DataFrame:
    """node, own: components of nodes once ``links`` between components are added."""
    if links.isEmpty():
        return labels
    found = components(links, store).select(F.col("node").alias("own"), F.col("label").alias("_label"))
    return store.written(labels.join(found, "own", "left").select("node", F.coalesce("_label", "own").alias("own")), "near-labels")


def _parts(placed: DataFrame) -> DataFrame:
    """The components of every bucket: key, own, size, and some member."""
    return placed.groupBy("key", "own").agg(F.count("*").alias("size"), F.min_by("node", F.xxhash64("node", "key")).alias("lead"))


def classes(docs: DataFrame, size: int, similarity: float, bands: int, rows: int, weighted: bool) -> DataFrame:
    """doc_id, t1, t2 (text hashes) of every row and c_id, c1, c2 of the row that stands for its class.

    ``docs`` has doc_id, text, t1 and t2; rows without a shingle stand for themselves.
    """
    store = Scratch(docs.sparkSession)
    told = store.written(described(docs, size, bands, rows, weighted), "near-rows")
    # the row that stands for a node: the smallest identifier, null last, then the text's hashes
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("row")
    grouped = told.where("n > 0").groupBy("d1", "d2").agg(first, F.first(F.struct("bands", "b1", "b2", "n")).alias("s"))
    nodes = store.written(grouped.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", F.col("row.doc_id").alias("c_id"), F.col("row.t1").alias("c1"), F.col("row.t2").alias("c2"), "s.bands", "s.b1", "s.b2", "s.n"), "near-nodes")
    keys = nodes.select(F.explode("bands").alias("key"), "node", "n", "b1", "b2")
    buckets = store.written(keys.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("leader")).where("members > 1"), "near-buckets")
    members = store.written(keys.hint("merge").join(buckets, "key"), "near-members")
    # texts become sets once, for nodes that share a bucket
    none = F.lit(-(1 << 63))
    named = members.select("node").distinct().join(nodes, "node").select("node", F.coalesce("c_id", none).alias("_id"), F.col("c1").alias("t1"), F.col("c2").alias("t2"))
    texts = docs.withColumn("_id", F.coalesce("doc_id", none)).hint("merge").join(named, ["_id", "t1", "t2"]).dropDuplicates(["_id", "t1", "t2"])
    sets = store.written(_sets(texts.select("node", "text"), size, weighted), "near-sets")

    # a bit of a coordinate agrees with probability (1 + similarity) / 2; sizes bound the similarity
    k, same = bands * rows, (1 + similarity) / 2
    most = int(np.ceil(k * (1 - same) + 5 * np.sqrt(k * same * (1 - same))))

    def alike(p: str, q: str):
        bits = F.bit_count(F.col(f"{p}.b1").bitwiseXOR(F.col(f"{q}.b1"))) + F.bit_count(F.col(f"{p}.b2").bitwiseXOR(F.col(f"{q}.b2")))
        return (bits <= most) & (F.least(f"{p}.n", f"{q}.n") >= F.greatest(f"{p}.n", f"{q}.n") * F.lit(similarity) - 1e-6)

    seen = nodes.select(F.col("node").alias("other"), "n", "b1", "b2")

    def starred(rim: DataFrame) -> DataFrame:
        """Links (u, v) between leaders and members of ``rim`` (node, own, n, b1, b2, leader, leader_own)."""
        pairs = rim.alias("m").hint("merge").join(seen.alias("o"), F.col("leader") == F.col("other")).where(alike("m", "o"))
        # written, so that the next join stands alone and Spark can split a leader with many members
        pairs = store.written(pairs.select(F.col("leader").alias("a"), F.col("node").alias("b"), F.col("leader_own").alias("u"), F.col("own").alias("v")), "near-pairs")
        return store.written(_linked(pairs, sets, similarity, weighted), "near-links")

    rim = members.where("node <> leader").select("node", F.col("node").alias("own"), "n", "b1", "b2", "leader", F.col("leader").alias("leader_own")).distinct()
    labels = _relabelled(members.select("node", F.col("node").alias("own")).distinct(), starred(rim), store)

    crowded = members.where(F.col("members") > CROWD)
    for _ in range(1, LEADERS if not crowded.isEmpty() else 1):
        placed = store.written(crowded.hint("merge").join(labels, "node"), "near-crowds")
        parts = _parts(placed)
        others = parts.join(parts.groupBy("key").agg(F.max_by("own", "size").alias("main")), "key").where("own <> main")
        leaders = store.written(others.groupBy("key").agg(F.min_by("lead", F.xxhash64("lead")).alias("leader"), F.min_by("own", F.xxhash64("lead")).alias("leader_own")), "near-leaders")
        if leaders.isEmpty():
            break
        rim = placed.drop("leader").hint("merge").join(leaders, "key").where("own <> leader_own").select("node", "own", "n", "b1", "b2", "leader", "leader_own").distinct()
        labels = _relabelled(labels, starred(rim), store)

    # what is left: members apart from their bucket's largest component, against the rest of the bucket
    placed = store.written(members.hint("merge").join(labels, "node"), "near-placed")
    mixed = store.written(_parts(placed).groupBy("key").agg(F.max_by("own", "size").alias("main"), F.count("*").alias("parts")).where("parts > 1"), "near-mixed")
    if not mixed.isEmpty():
        placed = store.written(placed.where("node <> leader").hint("merge").join(mixed, "key"), "near-apart")
        apart = placed.where("own <> main")
        few, many = F.col("members") <= SMALL, F.col("members") > SMALL
        # both apart: once, from the smaller; against members of the main component: from the one apart
        across = (F.col("p.key") == F.col("q.key")) & (F.col("p.own") != F.col("q.own")) & ((F.col("q.own") == F.col("q.main")) | (F.col("p.node") < F.col("q.node"))) & alike("p", "q")
        more = apart.where(few).alias("p").join(placed.where(few).alias("q"), across)
        more = more.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.own").alias("u"), F.col("q.own").alias("v")).distinct()
        links = _linked(more, sets, similarity, weighted)
        if not apart.where(many).isEmpty():
            links = links.union(_block_links(apart.where(many), placed.where(many), sets, similarity, weighted, store))
        labels = _relabelled(labels, store.written(links.distinct(), "near-links"), store)

    # of a class, the row that stands for the best of its nodes
    linked = nodes.select("node", "c_id", "c1", "c2").join(labels, "node")
    heads = linked.groupBy("own").agg(F.min(F.struct(F.col("c_id").isNull().alias("none"), "c_id", "c1", "c2")).alias("head"))
    headed = linked.select("node", "own").join(heads, "own").select(F.col("node").alias("_node"), "head")
    pick = lambda name: F.coalesce(F.when(F.col("head").isNotNull(), F.col(f"head.{name}")), F.col(name)).alias(name)
    whose = nodes.join(headed, F.col("node") == F.col("_node"), "left").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), pick("c_id"), pick("c1"), pick("c2"))
    whose = store.written(whose, "near-classes")
    store.clear(told, whose)
    rows_out = told.hint("merge").join(whose, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n") > 0), "left")
    alone = F.col("n") == 0
    return rows_out.select("doc_id", "t1", "t2", *[F.when(alone, F.col(own)).otherwise(F.col(c)).alias(c) for own, c in (("doc_id", "c_id"), ("t1", "c1"), ("t2", "c2"))])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and the two hashes t1, t2 of the text (null as empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def near_classes(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, kept for every row: classes of near-duplicates.

    Two texts are linked if the Jaccard similarity of their runs of ``size`` words (their different
    ones, or with counts if ``weighted``) is at least ``similarity``; classes are what links
    connect. class_id is the smallest doc_id of the class, whose row is kept.

    Words are compared in lower case without marks. A text of fewer than ``size`` words is one
    shingle; a text without words (null, empty) is a class of its own. Rows with equal shingles are
    one node, so copies cost nothing. Rows that share an identifier but not a text are told apart;
    repeated rows (identifier and text) get equal answers. Rows with a null identifier come last: a
    class of such rows alone has a null class_id and keeps one text. An empty table gives an empty
    result; other columns are not read.

    A pair at the threshold shares no band with probability (1 - 0.8^5)^24 = 7e-5 and is lost to the
    comparison of signature bits before the exact one with 3e-7; every other step is exact at every
    size, and nothing is capped. More ``bands`` make the first loss as small as wished.
    """
    found = classes(_keyed(docs, id_col, text_col), size, similarity, bands, rows, weighted)
    mine = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2"))
    return found.select("doc_id", F.col("c_id").alias("class_id"), mine.alias("kept"))


def deduplicated(docs: DataFrame, size: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_classes`` keeps, with all their columns; of repeated rows one stays.

    Rows are matched on identifier and text, so a row that only shares its identifier with one that
    goes stays. Columns of any name come back as they were.
    """
    found = classes(_keyed(docs, id_col, text_col), size, similarity, bands, rows, weighted)
    none = F.lit(-(1 << 63))
    own = free(docs, "id", "t1", "t2")
    stays = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2"))
    going = found.where(~stays).select(*[c.alias(name) for c, name in zip((F.coalesce("doc_id", none), F.col("t1"), F.col("t2")), own, strict=True)])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns(dict(zip(own, (F.coalesce(F.col(id_col).cast("long"), none), F.xxhash64(text), F.xxhash64(F.lit(1), text)), strict=True)))
    return keyed.hint("merge").join(going, own, "left_anti").dropDuplicates(own).select(*docs.columns)
