"""Append-only review log whose events hold the digest of what came before."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DECISIONS, ROLES, ACTION = ("accept", "reject", "needs_more_evidence"), ("reviewer", "admin"), "signal_reviewed"


def event_id(occurred_at: Column, actor: Column, source: Column, snapshot: Column, drug: Column, event: Column, decision: Column) -> Column:
    parts = [occurred_at, actor, source, snapshot, F.upper(drug), F.upper(event), decision]
    return F.substring(F.sha2(F.array_join(F.array(*parts), "\0"), 256), 1, 24)


def chained(events: DataFrame, log: str, order: list[str], line: str) -> DataFrame:
    """``events`` with previous_digest: SHA-256 of all earlier lines of the log, null for its first.

    A digest covers everything before it, so a log is one sequence: its rows go to one task, sorted,
    and one running digest is carried through them. Rows with a null log form one log.
    """
    kept = [c for c in events.columns if c != "previous_digest"]
    at, key = kept.index(line), kept.index(log)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, running, some = object(), hashlib.sha256(), False
        for batch in batches:
            out: list[str | None] = []
            for own, text in zip(batch.column(key).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if own != name:
                    name, running, some = own, hashlib.sha256(), False
                out.append(running.hexdigest() if some else None)
                running.update((text or "").encode())
                some = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*kept, "previous_digest"])

    rows = events.select(*kept)
    schema = StructType([*rows.schema.fields, StructField("previous_digest", StringType())])
    return rows.repartition(F.col(log)).sortWithinPartitions(log, *order).mapInArrow(digested, schema)


def appended(log: DataFrame, new: DataFrame) -> DataFrame:
    """Events to append to a log (events in order ``sequence``), with identifier, sequence, line and previous digest.

    ``new`` has occurred_at, actor, role, source, snapshot_id, drug, event, decision and rationale
    (strings); the log also action, event_id, sequence, line and previous_digest. A line is the event's
    JSON, keys sorted, with the SHA-256 of all lines before it, so new lines are made one after the
    other behind those of the log. New events are ordered by time and content. A decision or role that
    is unknown, or an actor or rationale that is blank, is refused. One writer appends at a time.
    """
    fields = ["occurred_at", "actor", "role", "source", "snapshot_id", "drug", "event", "decision", "rationale"]
    known = lambda c, of: F.coalesce(F.col(c).isin(*of), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    if not new.where(~known("decision", DECISIONS) | ~known("role", ROLES) | blank("actor") | blank("rationale")).isEmpty():
        raise ValueError("a review needs a known decision and role, an actor and a rationale")
    last = log.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    rows = new.select(*[F.upper(c).alias(c) if c in ("drug", "event") else F.col(c) for c in fields], F.lit(ACTION).alias("action"))
    rows = rows.withColumn("event_id", event_id(*[F.col(c) for c in ("occurred_at", "actor", "source", "snapshot_id", "drug", "event", "decision")]))
    rows = rows.withColumn("sequence", F.row_number().over(Window.orderBy("occurred_at", "event_id", "rationale")) + F.lit(last))  # a few reviews
    kept = [*fields, "action", "event_id"]
    both = log.select("sequence", "line", *[F.lit(None).cast("string").alias(c) for c in kept]).unionByName(rows.select("sequence", F.lit(None).cast("string").alias("line"), *kept))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, some = hashlib.sha256(), False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                before, line = running.hexdigest() if some else None, row["line"]
                if line is None:
                    line = json.dumps({c: row[c] for c in kept} | {"previous_digest": before}, sort_keys=True, separators=(",", ":")) + "\n"
                    out.append(row | {"line": line, "previous_digest": before})
                running.update(line.encode())
                some = True
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("sequence", pa.int32()), *[(c, pa.string()) for c in ("line", *kept, "previous_digest")]]))

    schema = "sequence int, line string, " + ", ".join(f"{c} string" for c in (*kept, "previous_digest"))
    found = both.withColumn("sequence", F.col("sequence").cast("int")).repartition(1).sortWithinPartitions("sequence").mapInArrow(linked, schema)
    return found.select(*kept, "sequence", "line", "previous_digest")


def broken_links(events: DataFrame, log: str, order: list[str], line: str) -> DataFrame:
    """Events whose stored previous_digest differs from that of the lines before them."""
    again = chained(events.withColumnRenamed("previous_digest", "stored"), log, order, line)
    return again.where(~F.col("stored").eqNullSafe(F.col("previous_digest")))
