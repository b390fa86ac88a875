"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logged conversations are often stored again after every turn. Rolling hashes of turn prefixes show
which logs are prefixes of longer ones; anti-joins keep the maximal ones. Everything is DataFrame
operations. Texts are shuffled once, for rendering; what comes before works on their digests.
Conversations are grouped by identifier, but for the few that hold a thousandth of all turns or
more: those are sorted across partitions, so no task holds a whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import Scratch

PART_TURNS = 64
#: A conversation is hot if it holds more than one part in ``HOT_SHARE`` of all turns, and more than ``HOT_TURNS``.
HOT_SHARE, HOT_TURNS = 1000, 10_000
#: Fixed marks around a rendered turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: A conversation: its identifier (0 for null) and whether that is null.
KEY = ["cid", "none"]
ORDER = ["turn", "role", "digest"]
#: Bits of a row's number within its partition.
WITHIN = 33


def _rows(turns: DataFrame, texts: bool) -> DataFrame:
    """Turns by conversation, with the text's digest and, on request, the text."""
    text = F.col("text").cast("string")
    columns = [F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("cid"), F.col("conv_id").cast("long").isNull().alias("none"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.unhex(F.md5(text)).alias("digest")]
    return turns.select(*columns, *([text.alias("text")] if texts else []))


def _terms(df: DataFrame) -> DataFrame:
    """Two hashes t1, t2 of every turn and its position; null role and text differ from empty ones."""
    terms = {f"t{seed}": F.xxhash64(F.lit(seed), F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("digest").isNull(), F.col("digest")) for seed in (1, 2)}
    return df.withColumns(terms)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with pos (from 1), in one task for each conversation."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER)).cast("long"))


def _numbered_hot(rows: DataFrame, store: Scratch) -> DataFrame:
    """``rows`` with pos (from 1) and part: sorted across partitions, numbered by the counts of earlier ones.

    The last sort key is the row's place in its input, so that equal turns can be dealt out too.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*KEY, *ORDER, "salt"]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    table = store.written(dealt.drop("salt").withColumn("at", F.monotonically_increasing_id()), "chat-hot")
    table = table.withColumns({"part": F.shiftright("at", WITHIN), "at": F.col("at").bitwiseAND((1 << WITHIN) - 1)})
    counts = table.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    earlier = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = table.join(earlier, "part").withColumn("rank", F.col("earlier") + F.col("at")).drop("at", "earlier")
    starts = ranked.groupBy(*KEY).agg(F.min("rank").alias("start"))  # a row a hot conversation
    return ranked.join(F.broadcast(starts), KEY).withColumn("pos", F.col("rank") - F.col("start") + 1).drop("rank", "start")


def prefixes(turns: DataFrame, hot: DataFrame | None, store: Scratch) -> DataFrame:
    """cid, none, pos, last, h1, h2: the hash of the first pos turns of its conversation, for every turn.

    A prefix's hash is the exclusive or of its turns' hashes, so parts of a conversation can be
    hashed apart and offset by what precedes them. ``last`` marks the whole conversation.
    """
    rows = _rows(turns, texts=False)
    cold = rows if hot is None else rows.join(F.broadcast(hot), KEY, "left_anti")
    upto = Window.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    last = F.lead(F.lit(False), 1, True).over(Window.partitionBy(*KEY).orderBy(*ORDER)).alias("last")
    out = _terms(_numbered(cold)).select(*KEY, "pos", last, *[F.bit_xor(f"t{i}").over(upto).alias(f"h{i}") for i in (1, 2)])
    if hot is not None:
        numbered = store.written(_terms(_numbered_hot(rows.join(F.broadcast(hot), KEY, "left_semi"), store)).select(*KEY, "part", "pos", "t1", "t2"), "chat-hot")
        sums = numbered.groupBy(*KEY, "part").agg(F.max("pos").alias("end"), *[F.bit_xor(f"t{i}").alias(f"x{i}") for i in (1, 2)])
        before = Window.partitionBy(*KEY).orderBy("part")
        zero = F.lit(0).cast("long")
        sums = sums.select(*KEY, "part", F.max("end").over(Window.partitionBy(*KEY)).alias("turns"), *[F.coalesce(F.bit_xor(f"x{i}").over(before.rowsBetween(Window.unboundedPreceding, -1)), zero).alias(f"x{i}") for i in (1, 2)])
        inside = Window.partitionBy(*KEY, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        local = numbered.select(*KEY, "part", "pos", *[F.bit_xor(f"t{i}").over(inside).alias(f"l{i}") for i in (1, 2)])
        out = out.unionByName(local.join(sums, [*KEY, "part"]).select(*KEY, "pos", (F.col("pos") == F.col("turns")).alias("last"), *[F.col(f"l{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"h{i}") for i in (1, 2)]))
    return store.written(out, "chat-prefixes")


def maximal(hashed: DataFrame) -> DataFrame:
    """cid, none, turns, copies of the conversations that no longer one begins with.

    Of equal conversations the smallest identifier stays (null only if all are).
    """
    name = F.min(F.when(~F.col("none"), F.col("cid")))
    classes = hashed.where("last").groupBy("pos", "h1", "h2").agg(name.alias("name"), F.count("*").alias("copies"))
    longer = hashed.where("not last").select("pos", "h1", "h2").distinct()
    kept = classes.join(longer, ["pos", "h1", "h2"], "left_anti")
    return kept.select(F.coalesce("name", F.lit(0)).alias("cid"), F.col("name").isNull().alias("none"), F.col("pos").alias("turns"), "copies")


def render(numbered: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, turns, copies, rendered: marked-up turns in order, ``part_turns`` of them a row (part from 0).

    Null roles and texts are rendered as empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))
    number = F.floor((F.col("pos") - 1) / part_turns).cast("long")
    parts = numbered.select(*KEY, "turns", "copies", number.alias("part"), F.struct("pos", turn.alias("turn")).alias("piece")).groupBy(*KEY, "turns", "copies", "part").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    name = F.when(~F.col("none"), F.col("cid"))
    return parts.select(name.alias("conv_id"), "part", "turns", "copies", F.array_join(F.transform("pieces", lambda p: p["turn"]), "").alias("rendered"))


def format_chats(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, turns, copies, rendered: the maximal conversations, rendered.

    A conversation that equals the first turns of a longer one is dropped; equal ones collapse to
    the smallest conv_id. Turns are ordered by turn, role and the text's digest (null first in each),
    so repeated rows stay as repeated turns. Rows with a null conv_id form one conversation. A
    conversation of more than ``part_turns`` turns takes several rows. An empty table gives an empty
    result; other columns are not read.
    """
    store = Scratch(turns.sparkSession)
    sizes = store.written(_rows(turns, texts=False).groupBy(*KEY).agg(F.count("*").alias("n")), "chat-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # fewer than HOT_SHARE conversations can be so large
    hot: DataFrame | None = sizes.where(F.col("n") > max(total / HOT_SHARE, HOT_TURNS)).select(*KEY)
    hot = None if hot.isEmpty() else hot
    kept = store.written(maximal(prefixes(turns, hot, store)), "chat-kept")
    rows = _rows(turns, texts=True)
    cold = rows if hot is None else rows.join(F.broadcast(hot), KEY, "left_anti")
    out = render(_numbered(cold.hint("merge").join(kept, KEY)), part_turns)
    held = [kept]
    if hot is not None:
        large = kept.join(F.broadcast(hot), KEY, "left_semi")
        numbered = store.written(_numbered_hot(rows.join(F.broadcast(large), KEY), store), "chat-hot")
        out = out.unionByName(render(numbered, part_turns))
        held += [numbered, sizes]
    store.clear(*held)
    return out
