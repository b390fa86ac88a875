"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort puts equal texts next
to each other, and neighbouring rows are compared in full. A group that is larger than a partition
simply spans several: the splitters order rows by text prefix, digest of the whole text and
identifier, so a hot text never lands in one task. Fragments of a text at partition edges (at most
two a partition, which bounds what is broadcast) are put together afterwards, by comparing whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import free, written

OUT = "doc_id long, text_sha256 string, fragment_id long, fragment_keep long, fragment_size long, first boolean, edge boolean, edge_text string"
NAMES = [c.split()[0] for c in OUT.split(", ")]
SPLITTER_CHARS = 64


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in one sorted partition; only identifiers of the open run are held."""
    part = TaskContext.get().partitionId() << 33
    ids: list[np.ndarray] = []  # of the open run
    nulls: list[np.ndarray] = []
    text = sha = None
    number = 0

    def only(value: str | None, rows: int) -> pa.Array:
        """The text of an edge fragment, in its first row."""
        return pa.concat_arrays([pa.array([value], pa.string()), pa.nulls(rows - 1, pa.string())])

    def closed(edge: bool) -> pa.RecordBatch:
        nonlocal number
        doc, null = np.concatenate(ids), np.concatenate(nulls)
        first = np.zeros(len(doc), bool)
        first[0] = True
        keep = None if null[0] else int(doc[0])
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, mask=null), pa.array([sha] * len(doc), pa.string()), pa.array(np.full(len(doc), part + number - 1)), pa.array([keep] * len(doc), pa.int64()), pa.array(np.full(len(doc), len(doc))), pa.array(first), pa.array(np.full(len(doc), edge)), only(text if edge else None, len(doc))],
            names=NAMES,
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        texts, shas = batch.column(1), batch.column(2)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = text is None or texts[0].as_py() != text
        doc = batch.column(0).fill_null(0).to_numpy()
        null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        head = int(at[0]) if len(at) else n
        if head:
            ids.append(doc[:head])
            nulls.append(null[:head])
        if not len(at):
            continue
        if ids:
            yield closed(edge=number == 0)
        size = np.diff(np.append(at, n))
        last = len(at) - 1
        if last:  # whole runs inside this batch
            lo, hi = int(at[0]), int(at[last])
            run = np.repeat(np.arange(last), size[:last])
            keep, no_keep = doc[at[:last]][run], null[at[:last]][run]
            edge = (run == 0) & (number == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[lo:hi], mask=null[lo:hi]), shas.slice(lo, hi - lo).cast(pa.string()), pa.array(part + number + run), pa.array(keep, mask=no_keep), pa.array(size[:last][run]), pa.array(new[lo:hi]), pa.array(edge), only(texts[lo].as_py() if number == 0 else None, hi - lo)],
                names=NAMES,
            )
            number += last
        ids, nulls = [doc[at[last] :]], [null[at[last] :]]
        text, sha = texts[int(at[last])].as_py(), shas[int(at[last])].as_py()
    if ids:
        yield closed(edge=True)


def exact_dedup(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their normalised bytes are (``normalise`` maps the text column; by default
    nothing changes). Of equal texts the row with the ``keep`` ("smallest" or "largest") identifier
    stays. Null text counts as empty. Rows with a null identifier take part: they lose to any other,
    and a group of such rows alone has a null keep_id. Repeated rows (same identifier and text) form
    a group of which exactly one row is kept. An empty table gives an empty result; other columns
    are not read. One shuffle moves the texts; what comes after moves identifiers and digests.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (normalise(text) if normalise else text).alias("t"))
    rows = rows.select("doc_id", "t", F.sha2("t", 256).alias("sha"), F.substring("t", 1, SPLITTER_CHARS).alias("prefix"))
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = rows.repartitionByRange(n, F.col("prefix"), F.col("sha"), order)
    ordered = parted.sortWithinPartitions(F.col("prefix"), F.col("sha"), F.col("t"), order)
    fragments = written(ordered.select("doc_id", "t", "sha").mapInArrow(_fragments, OUT), "content-sort")
    best = (F.min if keep == "smallest" else F.max)("fragment_keep")
    # the fragments of one text that lie at partition edges: no more rows than twice the partitions
    groups = fragments.where("edge and first").groupBy("text_sha256", "edge_text").agg(best.alias("group_keep"), F.sum("fragment_size").alias("group_size"), F.min("fragment_id").alias("group_first"), F.collect_list("fragment_id").alias("fragments"))
    edges = groups.select("group_keep", "group_size", "group_first", F.explode("fragments").alias("group_fragment"))
    whole = fragments.join(F.broadcast(edges), F.col("edge") & (F.col("fragment_id") == F.col("group_fragment")), "left")
    return whole.select(
        "doc_id",
        F.when(F.col("edge"), F.col("group_keep")).otherwise(F.col("fragment_keep")).alias("keep_id"),
        F.coalesce("group_size", "fragment_size").alias("group_size"),
        (F.col("first") & (F.col("fragment_id") == F.coalesce("group_first", "fragment_id"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, keep: str = "smallest", **options) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; of repeated rows one stays.

    Rows are matched on identifier and digest, so rows that share an identifier but not a text are
    told apart. Rows with a null identifier are kept only where no other row has their text. Columns
    of any name come back as they were.
    """
    id_col, text_col, normalise = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("normalise")
    own = free(docs, "id", "key")
    named = lambda column: F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)))
    kept = exact_dedup(docs, keep, **options).where("kept").select(named("doc_id").alias(own[0]), F.col("text_sha256").alias(own[1]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({own[0]: named(id_col), own[1]: F.sha2(normalise(text) if normalise else text, 256)})
    return keyed.join(kept, own, "left_semi").dropDuplicates(own).select(*docs.columns)
