"""Report-level 2x2 tables, overall or by group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrel.sources.scratch import written

#: Bits of a word, and words of pairs that a report may hold.
BITS, WORDS = 64, 16


@dataclass(frozen=True)
class Terms:
    """All drugs and events of some observations, few enough for a report to hold each, and their pairs, as bits."""

    drugs: tuple[str, ...]
    events: tuple[str, ...]

    @staticmethod
    def of(drugs: DataFrame, events: DataFrame) -> Terms | None:
        """The different values of two tables of one column; None if a kind has none, or there are too many."""
        found = [tuple(sorted(r[0] for r in df.dropna().distinct().limit(BITS + 1).collect())) for df in (drugs, events)]
        few = all(0 < len(x) <= BITS for x in found) and len(found[0]) * len(found[1]) <= BITS * WORDS
        return Terms(*found) if few else None

    @property
    def words(self) -> int:
        return -(-len(self.drugs) * len(self.events) // BITS)


def number(term: Column, names: Sequence[str]) -> Column:
    """The place of a term among ``names``, from 0; null stays null, and a term that is not there raises."""
    place = F.array_position(F.array(*map(F.lit, names)), term)
    return F.when(place == 0, F.raise_error(F.concat(F.lit("not among the terms: "), term)).cast("int")).otherwise((place - 1).cast("int"))


def _bit(word: str, place: Column) -> Column:
    return F.call_function("shiftright", F.col(word), place).bitwiseAND(1) == 1


def in_bits(terms: Terms, marked: Column | None = None) -> list[Column]:
    """Aggregates of a report's rows, whose drug and event are numbers: drug_bits, event_bits, and words shown_0... and marked_0... of its pairs.

    Numbers of fixed size are kept in place by a hash aggregate, which neither sorts nor serialises rows as sets of strings do.
    """
    bit = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), place)
    pair, there = F.col("drug") * len(terms.events) + F.col("event"), F.col("drug").isNotNull() & F.col("event").isNotNull()
    held = lambda condition, place, name: F.bit_or(F.when(condition, bit(place)).otherwise(F.lit(0).cast("long"))).alias(name)
    kinds = {"shown": there, **({} if marked is None else {"marked": there & F.coalesce(marked, F.lit(False))})}
    words = [held(c & pair.between(BITS * i, BITS * i + BITS - 1), pair - BITS * i, f"{n}_{i}") for n, c in kinds.items() for i in range(terms.words)]
    return [held(there, F.col("drug"), "drug_bits"), held(there, F.col("event"), "event_bits"), *words]


def listed(bits: str, names: Sequence[str]) -> Column:
    """The names whose bits are set."""
    return F.filter(F.array(*map(F.lit, names)), lambda _, i: _bit(bits, i))


def _told_apart(reports: DataFrame, by: list[str], kinds: list[str], terms: Terms) -> DataFrame:
    """``counts`` of reports that hold bits, before they are written: numbers are counted, the few results named."""
    numbers = lambda names: F.explode(F.array(*map(F.lit, range(-1, len(names)))))
    drug, event = F.col("drug"), F.col("event")
    rows = reports.select("*", numbers(terms.drugs).alias("drug")).where((drug < 0) | _bit("drug_bits", drug))
    rows = rows.select("*", numbers(terms.events).alias("event")).where((event < 0) | _bit("event_bits", event))
    pair = drug * len(terms.events) + event
    # the first word that reaches so far
    held = lambda kind: F.coalesce(*[F.when(pair < BITS * i + BITS, _bit(f"{kind}_{i}", pair - BITS * i)) for i in range(terms.words)])
    sums = rows.groupBy(*by, "drug", "event").agg(F.count("*").alias("k"), *[F.count_if((drug >= 0) & (event >= 0) & held(n)).alias(n) for n in kinds])
    name = lambda c, names: F.get(F.array(*map(F.lit, names)), F.col(c)).alias(c)
    return sums.select(*by, name("drug", terms.drugs), name("event", terms.events), "k", *kinds)


def whole(reports: DataFrame) -> DataFrame:
    """Reports with their sets, read together: a condition on all sets keeps Spark from planning each use of one apart.

    All tables of the same reports then share one shuffle of the observations.
    """
    sets = [c for c in ("drugs", "events", "shown", "marked") if c in reports.columns]
    return reports.where(sum((F.size(c) for c in sets), F.lit(0)) > 0)


def gathered(obs: DataFrame, by: list[str] | None = None, marked: Column | None = None, terms: Terms | None = None) -> DataFrame:
    """[by...], report_id, drugs, events, shown[, marked]: one row a report with the sets that its rows show.

    ``shown`` holds the pairs of its rows, ``marked`` those of its rows that meet a condition. Rows
    with a null report, drug, event or group are left out. With ``terms`` drugs and events are numbers
    of these, and a report has the columns of ``in_bits``.
    """
    keys = [*(by or []), "report_id", "drug", "event"]
    rows = obs.select(*keys, *([] if marked is None else [marked.alias("_marked")])).dropna(subset=keys)
    if terms:
        return rows.groupBy(*(by or []), "report_id").agg(*in_bits(terms, None if marked is None else F.col("_marked")))
    entry = F.struct("drug", "event", *([] if marked is None else [F.coalesce("_marked", F.lit(False)).alias("marked")]))
    return unfolded(rows.groupBy(*(by or []), "report_id").agg(F.collect_set(entry).alias("_entries")), "_entries", *(by or []), "report_id")


def unfolded(reports: DataFrame, entries: str, *keep: str) -> DataFrame:
    """keep..., drugs, events, shown[, marked] of reports whose ``entries`` are a set of (drug, event[, marked]); without entries they are left out.

    Reports gather one set, as each further one costs as much again; the others are read off it.
    """
    e, sets = F.col(entries), {"drugs": F.array_distinct(f"{entries}.drug"), "events": F.array_distinct(f"{entries}.event"), "shown": F.col(entries)}
    if "marked" in reports.schema[entries].dataType.elementType.names:
        pair = lambda x: F.struct(x["drug"].alias("drug"), x["event"].alias("event"))
        some, all_ = F.array_contains(f"{entries}.marked", True), ~F.array_contains(f"{entries}.marked", False)
        pairs = F.arrays_zip(f"{entries}.drug", f"{entries}.event")
        # a pair may be there marked and not: in order, the two lie side by side
        once = lambda a: F.filter(a, lambda x, i: (i == 0) | (pair(x) != pair(F.get(a, i - 1))))
        sets["shown"] = F.when(~some | all_, pairs).otherwise(F.transform(once(F.array_sort(e)), pair))
        sets["marked"] = F.when(~some, F.slice(pairs, 1, 0)).when(all_, pairs).otherwise(F.transform(F.filter(e, lambda x: x["marked"]), pair))
    return reports.where(F.size(entries) > 0).select(*keep, *[c.alias(n) for n, c in sets.items()])


def _pairs(reports: DataFrame, *keep: str) -> DataFrame:
    """Every drug with every event of the same report."""
    return reports.select(*keep, F.explode("drugs").alias("drug"), "events").select(*keep, "drug", F.explode("events").alias("event"))


def counts(reports: DataFrame, by: list[str] | None = None, shown: bool = True, terms: Terms | None = None) -> DataFrame:
    """[by...], drug, event, k[, shown, marked]: reports of a pair; of a drug (event null), an event (drug null) and all (both null).

    The rows of ``gathered`` are read once: a drug or none meets an event or none, and what a report
    gives is added up before it is shuffled. ``shown`` (unless not asked for) and ``marked`` count the
    reports whose rows show the pair and show it marked. The counts are written to the shared folder.
    Reports that ``terms`` made hold bits instead of arrays.
    """
    by = by or []
    keys = [*by, "drug", "event"]
    if terms:
        kinds = [n for n in ("shown", "marked") if f"{n}_0" in reports.columns and (shown or "marked_0" in reports.columns)]
        return written(_told_apart(reports, by, kinds, terms), "report-counts")
    or_none = lambda c: F.explode(F.concat(F.col(c), F.array(F.lit(None))))
    sets = [c for c in ("shown", "marked") if c in reports.columns and (shown or "marked" in reports.columns)]
    every = F.size("shown") == F.size("drugs") * F.size("events") if sets else F.lit(True)
    rows = reports.select(*by, or_none("drugs").alias("drug"), "events", *sets, every.alias("_every")).select(*by, "drug", or_none("events").alias("event"), *sets, "_every")
    pair = F.col("drug").isNotNull() & F.col("event").isNotNull()
    # most reports show all their pairs, marked or not as a whole
    held = {"shown": F.when(F.col("_every"), True).otherwise(F.array_contains("shown", F.struct("drug", "event")))}
    if "marked" in sets:
        held["marked"] = F.when(F.size("marked") == 0, False).when(F.size("marked") == F.size("shown"), held["shown"]).otherwise(F.array_contains("marked", F.struct("drug", "event")))
    return written(rows.groupBy(*keys).agg(F.count("*").alias("k"), *[F.count_if(pair & c).alias(n) for n, c in held.items() if n in sets]), "report-counts")


def parts(counted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows of ``counts``: of pairs (with a), drugs (nd), events (ne) and all (n)."""
    of = lambda drug, event, name, *drop: counted.where(f"drug is {drug} and event is {event}").withColumnRenamed("k", name).drop("shown", "marked", *drop)
    pairs = counted.where("drug is not null and event is not null").withColumnRenamed("k", "a")
    return pairs, of("not null", "null", "nd", "event"), of("null", "not null", "ne", "drug"), of("null", "null", "n", "drug", "event")


def tables(reports: DataFrame, by: list[str] | None = None, pairs: DataFrame | str = "shown", dense: bool = False, minimum: int = 0, terms: Terms | None = None) -> DataFrame:
    """[by...], drug, event, a, b, c, d, n[, marked] from the rows of ``gathered``.

    ``a`` counts reports that hold the drug and the event anywhere, not rows that hold both; the
    marginals give the other cells. The pairs are those that rows show ("shown"), those of the same
    report ("report") or a table. Shown pairs are listed for each group in which rows show them, or
    for every group if ``dense``; other pairs for every group. Groups of fewer than ``minimum``
    reports, or with a null key, are left out before pairs are listed. ``counts`` are made here.
    """
    by = by or []
    extra = ["marked"] if {"marked", "marked_0"} & set(reports.columns) else []
    counted = counts(reports, by, isinstance(pairs, str) and pairs != "report", terms)
    both, per_drug, per_event, total = parts(counted.dropna(subset=by) if by else counted)
    total = total.where(F.col("n") >= minimum) if by else total.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    grid = by and (dense or not isinstance(pairs, str) or pairs == "report")
    if isinstance(pairs, DataFrame):
        universe = pairs.select("drug", "event").distinct()
    elif not grid:
        universe = None  # the pairs of a group are its rows
        both = both.where("shown > 0") if pairs != "report" else both
    elif pairs == "report":
        universe = parts(counted)[0].select("drug", "event").distinct()
    else:
        universe = both.where("shown > 0").select("drug", "event").distinct()
    both = both.drop("shown")
    if universe is None:
        out = both
    else:
        universe = universe.crossJoin(total.select(*by)) if by else universe  # with the few groups
        out = universe.join(both, [*by, "drug", "event"], "left")
    out = out.join(per_drug, [*by, "drug"], "left").join(per_event, [*by, "event"], "left")
    out = (out.join(total, by) if by else out.crossJoin(total)).na.fill(0, ["a", "nd", "ne", *extra])
    return out.select(*by, "drug", "event", "a", (F.col("nd") - F.col("a")).alias("b"), (F.col("ne") - F.col("a")).alias("c"), (F.col("n") - F.col("nd") - F.col("ne") + F.col("a")).alias("d"), "n", *extra)


def contingency(obs: DataFrame, by: list[str] | None = None, pairs: DataFrame | str = "shown", dense: bool = False, terms: Terms | None = None) -> DataFrame:
    """``tables`` of rows (report_id, drug, event, [by...])."""
    return tables(gathered(obs, by, terms=terms), by, pairs, dense, terms=terms)


def report_pairs(reports: DataFrame) -> DataFrame:
    """The different pairs of a drug and an event of the same report."""
    return _pairs(reports).distinct()
