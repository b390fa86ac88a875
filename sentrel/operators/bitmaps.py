"""Sets of reports as bitmaps: built once, then cells and comparator arms without the observations.

Reports are numbered by their order and dealt into buckets of 32,768 numbers. A term has one row a
bucket in which it occurs: a bitmap of 4 KB, or its numbers themselves where these take less, so a
term takes at most 4 KB a bucket, however many reports show it, and rare terms take what their
reports take. Counts of unions and intersections are counts of bits, or of numbers where one side
lists them. For all shown pairs of a whole snapshot ``contingency`` moves less; bitmaps serve questions
about chosen pairs, drugs and arms of a snapshot that is asked again and again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.functions import statistics as st
from sentrel.sources.scratch import Scratch

from .order import placed

#: Fixed: bytes of a bitmap of one bucket.
BITMAP = 4096
#: Numbers (of four bytes) up to which a row lists them.
LISTED = BITMAP // 4


def numbered(obs: DataFrame, store: Scratch) -> DataFrame:
    """report_id, number: different reports in order, from 1 without gaps."""
    return placed(obs.select("report_id").where("report_id is not null").distinct(), [], ["report_id"], store, "number")


def _bits(positions: pa.Array) -> pa.Array:
    """Bitmaps of lists of positions, as Spark's ``bitmap_construct_agg`` lays them out; null for short lists."""
    out: list[bytes | None] = [None] * len(positions)
    for i in np.flatnonzero(positions.value_lengths().to_numpy(zero_copy_only=False) > LISTED):
        bits = np.zeros(BITMAP * 8, np.uint8)
        bits[positions[int(i)].values.to_numpy(zero_copy_only=False)] = 1
        out[i] = np.packbits(bits, bitorder="little").tobytes()
    return pa.array(out, pa.binary())


def _listed(bitmaps: pa.Array) -> pa.Array:
    """Lists of the positions of bitmaps."""
    return pa.array([np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) for b in bitmaps.to_pylist()], pa.list_(pa.int64()))


def built(obs: DataFrame, store: Scratch) -> DataFrame:
    """kind (drug, event, all), term, bucket, positions, bitmap of rows report_id, drug, event; rows with a null are left out.

    A row holds its reports as positions (up to ``LISTED``) or as a bitmap; the other column is null.
    Rows are shuffled once to their report and once to their bucket, where every set is made whole.
    """
    rows = obs.select("report_id", "drug", "event").dropna()
    sides = rows.join(numbered(rows, store), "report_id").select(
        F.bitmap_bucket_number("number").alias("bucket"), F.bitmap_bit_position("number").alias("position"),
        F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), term.cast("string").alias("term")) for kind, term in (("drug", F.col("drug")), ("event", F.col("event")), ("all", F.lit("")))])).alias("of"),
    )
    parts = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # long sets grow as bitmaps; the others never take more than their own numbers
    different = sides.select("of.*", "bucket", "position").repartition(parts, "bucket").groupBy("kind", "term", "bucket").agg(F.collect_set("position").alias("positions"))
    short = F.size("positions") <= LISTED
    return different.select("kind", "term", "bucket", F.when(short, F.col("positions")).alias("positions"), F.arrow_udf(_bits, "binary")(F.when(short, F.array().cast("array<bigint>")).otherwise(F.col("positions"))).alias("bitmap"))


def sizes(bitmaps: DataFrame) -> DataFrame:
    """kind, term, n: reports of every term."""
    return bitmaps.groupBy("kind", "term").agg(F.sum(F.coalesce(F.bitmap_count("bitmap"), F.size("positions").cast("long"))).alias("n"))


def _overlap(one: pa.Array, other: pa.Array) -> pa.Array:
    words = [np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(-1, BITMAP // 8) for x in (one, other)]
    return pa.array(np.bitwise_count(words[0] & words[1]).sum(axis=1, dtype=np.int64))


def overlap():
    """Reports that two bitmaps of a bucket share, as a function of two columns."""
    return F.arrow_udf(_overlap, "long")


def _terms(bitmaps: DataFrame, kind: str, name: str) -> DataFrame:
    return bitmaps.where(F.col("kind") == kind).select(F.col("term").alias(name), "bucket", "positions", F.col("bitmap").alias(f"{name}_bitmap"))


def _numbers(terms: DataFrame, name: str) -> DataFrame:
    """name, bucket, position, long: a row a report of each term."""
    lists = terms.where("positions is not null").select(name, "bucket", F.explode("positions").alias("position"), F.lit(False).alias("long"))
    sets = terms.where(f"{name}_bitmap is not null").select(name, "bucket", F.arrow_udf(_listed, "array<bigint>")(f"{name}_bitmap").alias("all"))
    return lists.unionByName(sets.select(name, "bucket", F.explode("all").alias("position"), F.lit(True).alias("long")))


def shared(one: DataFrame, other: DataFrame, names: tuple[str, str], asked: DataFrame | None = None) -> DataFrame:
    """names, n: reports that two terms (rows of ``_terms``) share, of all pairs or the asked ones; pairs without any may be missing.

    Two bitmaps are compared as they are. Where a side lists its numbers, both sides' numbers meet: such
    a list is shorter than a bitmap, and a frequent term is spread over its numbers. Numbers are always
    shuffled: Spark takes a bitmap's 32,768 numbers for one row and would broadcast them through the driver.
    """
    a, b = names
    long = lambda terms, name: terms.where(F.col(f"{name}_bitmap").isNotNull()).drop("positions")
    left = long(one, a) if asked is None else asked.join(long(one, a), a)
    words = left.join(long(other, b), ["bucket"] if asked is None else [b, "bucket"]).select(a, b, overlap()(f"{a}_bitmap", f"{b}_bitmap").alias("n"))
    met = _numbers(one, a).join(_numbers(other, b).withColumnRenamed("long", "_long").hint("merge"), ["bucket", "position"]).where("not (long and _long)")
    found = met.groupBy(a, b).agg(F.count("*").alias("n"))
    found = found if asked is None else found.join(asked, [a, b], "left_semi")
    return words.unionByName(found).groupBy(a, b).agg(F.sum("n").alias("n"))


def cells(bitmaps: DataFrame, pairs: DataFrame) -> DataFrame:
    """drug, event, a, b, c, d, n of the different ``pairs``, as ``contingency.tables`` counts them."""
    asked = pairs.select("drug", "event").distinct()
    of_asked = lambda name: _terms(bitmaps, name, name).join(asked.select(name).distinct(), name, "left_semi")
    both = shared(of_asked("drug"), of_asked("event"), ("drug", "event"), asked).withColumnRenamed("n", "a")
    known = sizes(bitmaps)
    of = lambda kind, to: known.where(F.col("kind") == kind).select(F.col("term").alias(kind), F.col("n").alias(to))
    rows = asked.join(both, ["drug", "event"], "left").join(of("drug", "nd"), "drug", "left").join(of("event", "ne"), "event", "left").crossJoin(known.where("kind = 'all'").select("n")).na.fill(0, ["a", "nd", "ne"])
    return rows.select("drug", "event", "a", (F.col("nd") - F.col("a")).alias("b"), (F.col("ne") - F.col("a")).alias("c"), (F.col("n") - F.col("nd") - F.col("ne") + F.col("a")).alias("d"), "n")


def arms(bitmaps: DataFrame, comparators: DataFrame) -> DataFrame:
    """drug, arm (own, any), bucket, bitmap: reports of a drug, and of it or any of its comparators (rows drug, comparator)."""
    wanted = comparators.select(F.upper("drug").alias("drug"), F.upper("comparator").alias("comparator"))
    roles = wanted.select("drug", F.col("drug").alias("name"), F.explode(F.array(F.lit("own"), F.lit("any"))).alias("arm")).union(wanted.select("drug", "comparator", F.lit("any"))).distinct()
    taken, of = roles.join(_terms(bitmaps, "drug", "name"), "name"), ["drug", "arm", "bucket"]
    lists = taken.where("positions is not null").select(*of, F.explode("positions").alias("position")).groupBy(*of).agg(F.bitmap_construct_agg("position").alias("bitmap"))
    return lists.unionByName(taken.where("name_bitmap is not null").select(*of, F.col("name_bitmap").alias("bitmap"))).groupBy(*of).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def active_comparator(bitmaps: DataFrame, comparators: DataFrame) -> DataFrame:
    """``adjusted.active_comparator`` from bitmaps: a report of a drug and its comparator counts for the drug.

    The comparator's share of an event is what either arm has less what the drug has.
    """
    named = arms(bitmaps, comparators)
    is_own = F.col("arm") == "own"
    split = lambda n, own, every: [F.sum(F.when(is_own, n)).alias(own), F.sum(F.when(~is_own, n)).alias(every)]
    total = named.groupBy("drug").agg(*split(F.bitmap_count("bitmap"), "n1", "n"))
    armed = named.select(F.struct("drug", "arm").alias("of"), "bucket", F.lit(None).cast("array<bigint>").alias("positions"), F.col("bitmap").alias("of_bitmap"))
    met = shared(armed, _terms(bitmaps, "event", "event"), ("of", "event")).select("of.*", "event", F.col("n").alias("shared"))
    found = met.groupBy("drug", "event").agg(*split(F.col("shared"), "a", "either")).where("a > 0").join(total, "drug")
    rows = found.select("drug", "event", "a", (F.col("n1") - F.col("a")).alias("b"), (F.col("either") - F.col("a")).alias("c"), (F.col("n") - F.col("n1") - F.col("either") + F.col("a")).alias("d"), F.col("n").alias("reports_used"))
    lower, upper = st.bounds(st.ror(), st.ror_error())
    return rows.select("*", st.ror().alias("estimate"), lower.alias("lower_bound"), upper.alias("upper_bound"))
