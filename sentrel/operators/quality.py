"""Validation, deduplication, curation and quality reports of raw snapshots.

Raw records are JSON strings with their place (page, index). They are looked at as variants, which
tell a missing key, a null and a value of the wrong type apart.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrel.functions import normalize as nz
from sentrel.sources.scratch import Scratch

REPORT = (
    "safetyreportid string, receivedate string, serious string, patient struct<patientonsetage: string, patientonsetageunit: string, patientsex: string, "
    "reaction: array<struct<reactionmeddrapt: string>>, drug: array<struct<medicinalproduct: string, drugcharacterization: string, "
    "openfda: struct<generic_name: array<string>, substance_name: array<string>, brand_name: array<string>>>>>"
)
SAMPLE = (
    "record_id string, site string, state_territory string, source string, sample_id string, sample_collect_date string, pcr_target string, date_updated string, "
    "county_fips string, population_served string, pcr_target_avg_conc string, pcr_target_units string, pcr_target_detect string"
)
SAMPLE_TEXTS = ("record_id", "site", "state_territory", "source", "sample_id", "pcr_target")
SAMPLE_FIELDS = ("record_id", "site", "state_territory", "source", "sample_id", "sample_collect_date", "pcr_target", "date_updated")
REPORT_FIELDS = ("safetyreportid", "receivedate", "patient", "patient.drug", "patient.reaction")
NO_PAIR = "no_usable_pair"
THRESHOLD = 0.95


def _kind(path: str) -> Column:
    """Type name of the value at a path of column v: null if the key is missing, VOID for null."""
    return F.schema_of_variant(F.try_variant_get("v", path, "variant"))


def _text(path: str) -> Column:
    return F.try_variant_get("v", path, "string")


def _blank(path: str) -> Column:
    return F.coalesce((_kind(path) != "STRING") | (F.trim(F.regexp_replace(_text(path), nz.SPACES, " ")) == ""), F.lit(True))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with costly columns made once a row: they are a generator's only row, which no condition on them passes.

    Spark would take such a condition (an explode brings one) with all that makes the columns down to
    the joins below, and parse there for each use.
    """
    held = rows.withColumn("_held", F.struct(*[c.alias(n) for n, c in columns.items()])).withColumn("_made", F.explode(F.array("_held")))
    return held.withColumns({n: F.col(f"_made.{n}") for n in columns}).drop("_held", "_made")


def _judged(rows: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """``rows`` with reasons: the names of all checks that hold.

    A set operation takes the nulls out, as checks inside of a higher-order function are not compiled.
    """
    return _once(rows, reasons=F.array_except(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]), F.array(F.lit(None).cast("string"))))


def _whole(path: str, least: int, absent: bool) -> Column:
    """Whether a value can't be read as a whole number of at least ``least`` (numbers, numeric strings, true and false can)."""
    number = F.when(_kind(path) == "BOOLEAN", F.try_variant_get("v", path, "boolean").cast("double")).otherwise(F.trim(_text(path)).try_cast("double"))
    fine = F.coalesce((number >= least) & (number == F.floor(number)), F.lit(False))
    return ~fine & (_kind(path).isNotNull() if absent else F.lit(True))


def _present(fields: dict[str, Column]) -> Column:
    return F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in fields.items()]).alias("present")


def _kinds() -> dict[str, Column]:
    """What the write of told versions counts: those of each kind that are left out."""
    return {kind: F.count_if(F.col("kind") == kind) for kind in ("followup", "duplicate")}


def _seen(fields: Sequence[str]) -> dict[str, Column]:
    """What the write of a validated table counts: records, valid ones, and those that have each field."""
    return {"input_records": F.count(F.lit(1)), "valid_records": F.count_if(F.size("reasons") == 0)} | {f"has {n}": F.count_if(F.coalesce(F.col("present").getField(n), F.lit(False))) for n in fields}


def _told(seen: dict[str, int]) -> list[Column]:
    return [F.lit(seen[n]).cast("long").alias(n) for n in ("input_records", "valid_records")]


def _complete(seen: dict[str, int], fields: Sequence[str]) -> list[Column]:
    """completeness by field and its least, of counts that ``_seen`` named; as ``completeness`` rounds them."""
    total = F.lit(seen["input_records"]).cast("double")
    shares = [F.round(F.coalesce(F.try_divide(F.lit(seen[f"has {n}"]).cast("double"), total), F.lit(0.0)), 4) for n in sorted(fields)]
    return [F.map_from_arrays(F.array(*map(F.lit, sorted(fields))), F.array(*shares)).alias("completeness"), F.array_min(F.array(*shares)).alias("least_completeness")]


def validate_reports(raw: DataFrame) -> DataFrame:
    """``raw`` (page, index, payload) with reasons (empty: valid), report_id, version, the typed report and which fields are present.

    Reasons are stable codes and all that apply are listed. A version may be missing (1) but not null.
    """
    day = F.try_to_timestamp(_text("$.receivedate"), F.lit("yyyyMMdd"))
    nested = F.from_json("payload", REPORT)
    reactions = F.try_variant_get("v", "$.patient.reaction", "array<variant>")
    bad_reaction = F.exists(reactions, lambda r: F.coalesce((F.schema_of_variant(F.try_variant_get(r, "$.reactionmeddrapt", "variant")) != "STRING") | (F.trim(F.regexp_replace(F.try_variant_get(r, "$.reactionmeddrapt", "string"), nz.SPACES, " ")) == ""), F.lit(True)))
    rows = raw.withColumn("v", F.try_parse_json("payload"))
    rows = _judged(
        rows,
        (F.coalesce(~F.schema_of_variant("v").startswith("OBJECT"), F.lit(True)), "record: not an object"),
        (_blank("$.safetyreportid"), "safetyreportid: blank or not a string"),
        (_whole("$.safetyreportversion", 1, absent=True), "safetyreportversion: not a whole number from 1"),
        (F.coalesce((_kind("$.receivedate") != "STRING") | ~_text("$.receivedate").rlike(r"^[0-9]{8}\z") | day.isNull(), F.lit(True)), "receivedate: not a calendar day"),
        (F.coalesce(~_kind("$.patient").startswith("OBJECT"), F.lit(True)), "patient: missing"),
        (F.coalesce(F.size(F.try_variant_get("v", "$.patient.drug", "array<variant>")) < 1, F.lit(True)), "patient.drug: no entry"),
        (F.coalesce((F.size(reactions) < 1) | bad_reaction, F.lit(True)), "patient.reaction: no entry or a blank one"),
    )
    version = F.coalesce(F.when(_kind("$.safetyreportversion") == "BOOLEAN", F.lit(1)), F.trim(_text("$.safetyreportversion")).try_cast("double").cast("long"), F.lit(1))
    return rows.select(*raw.columns, "reasons", _text("$.safetyreportid").alias("report_id"), F.when(F.size("reasons") == 0, version).cast("long").alias("version"), nested.alias("report"), _present(report_fields()))


def validate_samples(raw: DataFrame) -> DataFrame:
    """``raw`` with reasons, record_id, updated (timestamp) and the typed sample of the second source."""
    concentration, people = _text("$.pcr_target_avg_conc").try_cast("double"), "$.population_served"
    number = lambda path: _kind(path).isNotNull() & (_kind(path) != "VOID")
    day = F.to_timestamp(F.col("_day"))
    rows = raw.withColumn("v", F.try_parse_json("payload")).withColumn("_day", F.try_to_timestamp(_text("$.sample_collect_date")))
    rows = _judged(
        rows,
        (F.coalesce(~F.schema_of_variant("v").startswith("OBJECT"), F.lit(True)), "record: not an object"),
        *[(_blank(f"$.{x}"), f"{x}: blank or not a string") for x in SAMPLE_TEXTS],
        (F.coalesce(day != F.date_trunc("day", day), F.lit(True)), "sample_collect_date: not a day"),
        (F.try_to_timestamp(_text("$.date_updated")).isNull(), "date_updated: not a time"),
        (number(people) & _whole(people, 1, absent=True), "population_served: not a whole number from 1"),
        (number("$.pcr_target_avg_conc") & ~F.coalesce((concentration >= 0) & ~F.isnan(concentration), F.lit(False)), "pcr_target_avg_conc: not a number from 0"),
    )
    return rows.select(*raw.columns, "reasons", _text("$.record_id").alias("record_id"), F.try_to_timestamp(_text("$.date_updated")).alias("updated"), F.from_json("payload", SAMPLE).alias("sample"), _present({x: _kind(f"$.{x}").isNotNull() & (_kind(f"$.{x}") != "VOID") & (_text(f"$.{x}") != "") for x in SAMPLE_FIELDS}))


def classified(rows: DataFrame, key: str, version: str, order: list[str]) -> DataFrame:
    """``rows`` with kind (first, followup, duplicate) in arrival order and winner.

    The winner of a key is the first row of its highest version. A row is a duplicate if it equals
    the highest version before it, else a follow-up. Null versions come lowest.
    """
    arrival = Window.partitionBy(key).orderBy(*order)
    best = F.max(version).over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(version), *order))
    kind = F.when(F.row_number().over(arrival) == 1, "first").when(F.col(version).eqNullSafe(best), "duplicate").otherwise("followup")
    return rows.withColumns({"kind": kind, "winner": place == 1})


def latest(rows: DataFrame, key: str, version: str, order: list[str]) -> DataFrame:
    return classified(rows, key, version, order).where("winner").drop("kind", "winner")


def _digests(payloads: pa.Array) -> pa.Array:
    out = []
    for text in payloads.to_pylist():
        try:
            data = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
        except (TypeError, ValueError):  # no JSON at all: the text itself
            data = text
        out.append(None if data is None else hashlib.sha256(data.encode()).hexdigest())
    return pa.array(out, pa.string())


def payload_digest() -> Column:
    """SHA-256 of a record as sorted ASCII JSON, so its spacing and the order of its keys do not matter; of rejected records only."""
    return F.arrow_udf(_digests, "string")("payload").alias("payload_sha256")


def curate_reports(reports: DataFrame) -> DataFrame:
    """One row per different (drug, role, reaction) of a report; the first entry of a drug and role gives the name's source.

    Columns also hold position (of the drug entry). Drugs without any name are left out. A report is a
    row with its drugs in an array, so entries are told apart where they are.
    """
    person = F.col("report.patient")
    years = nz.age_years(person["patientonsetage"], person["patientonsetageunit"])

    def entry(drug: Column, position: Column) -> Column:
        brand = drug["openfda"]
        name, source = nz.normalize_drug_name(brand["generic_name"], brand["substance_name"], brand["brand_name"], drug["medicinalproduct"])
        return F.struct(position.alias("position"), name.alias("drug_name"), source.alias("drug_name_source"), nz.drug_role(drug["drugcharacterization"]).alias("drug_role"))

    rows = reports.select(
        "page", "index", "report_id", "version", F.to_date("report.receivedate", "yyyyMMdd").alias("received_date"), nz.serious(F.col("report.serious")).alias("serious"),
        F.round(years, 3).alias("patient_age_years"), nz.age_band(years).alias("patient_age_group"), nz.patient_sex(person["patientsex"]).alias("patient_sex"),
        F.array_sort(F.array_distinct(F.transform(person["reaction"], lambda r: nz.normalize_term(r["reactionmeddrapt"])))).alias("reactions"), F.transform(person["drug"], entry).alias("entries"),
    )
    rows = rows.withColumn("entries", F.filter("entries", lambda e: e["drug_name"].isNotNull()))
    rows = rows.withColumns({
        "fallbacks": F.size(F.filter("entries", lambda e: e["drug_name_source"] == "reported_medicinal_product")).cast("long"),
        "keys": F.transform("entries", lambda e: F.struct(e["drug_name"], e["drug_role"])),
    })
    first = F.filter("entries", lambda e, i: F.array_position("keys", F.struct(e["drug_name"], e["drug_role"])) == i + 1)
    rows = _once(rows, first=first, shown=F.col("reactions")).withColumn("entry", F.explode("first")).withColumn("reaction", F.explode("shown"))
    return rows.select(*[c for c in rows.columns if c not in ("entries", "keys", "entry", "reactions", "first", "shown", "fallbacks", "reaction")], "entry.*", "fallbacks", "reaction")


def curate_samples(samples: DataFrame) -> DataFrame:
    text = lambda x: F.col(f"sample.{x}")
    return samples.select(
        "record_id", text("site").alias("site_id"), F.upper(F.trim(text("state_territory"))).alias("state_territory"), nz.normalize_term(text("source")).alias("reporting_source"), text("county_fips").alias("county_fips"),
        text("population_served").try_cast("double").cast("long").alias("population_served"), text("sample_id").alias("sample_id"), F.to_date(F.to_timestamp(text("sample_collect_date"))).alias("sample_collect_date"),
        nz.normalize_term(text("pcr_target")).alias("pathogen"), text("pcr_target_avg_conc").try_cast("double").alias("concentration"), nz.normalize_term(text("pcr_target_units")).alias("concentration_units"),
        F.when(F.lower(F.trim(text("pcr_target_detect"))) == "yes", True).when(F.lower(F.trim(text("pcr_target_detect"))) == "no", False).alias("target_detected"), F.col("updated").alias("source_updated_at"),
    )


def completeness(rows: DataFrame, present: dict[str, Column]) -> DataFrame:
    """field, share: how many rows have each field (4 places; 0 without rows)."""
    sums = rows.agg(*[F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0.0)), 4).alias(n) for n, c in present.items()])
    return sums.unpivot([], [F.col(f"`{n}`") for n in present], "field", "share")


def report_fields() -> dict[str, Column]:
    """What counts as present in raw reports (column v): neither null nor empty."""
    filled = lambda p: _kind(p).isNotNull() & (_kind(p) != "VOID") & (_text(p) != "")
    some = lambda p: F.size(F.try_variant_get("v", p, "array<variant>")) > 0
    return {"safetyreportid": filled("$.safetyreportid"), "receivedate": filled("$.receivedate"), "patient": _kind("$.patient").startswith("OBJECT"), "patient.drug": some("$.patient.drug"), "patient.reaction": some("$.patient.reaction")}


def checks(metrics: DataFrame, curated: bool = True) -> DataFrame:
    """name, status, observed, threshold from one row of input_records, valid_records, least_completeness, curated_rows, age_days."""
    rate = F.coalesce(F.try_divide(F.col("valid_records").cast("double"), F.col("input_records")), F.lit(0.0))
    row = lambda name, status, observed, threshold: F.struct(F.lit(name).alias("name"), status.alias("status"), observed.cast("double").alias("observed"), F.lit(threshold).alias("threshold"))
    hard = lambda c: F.when(c > 0, "pass").otherwise("fail")
    soft = lambda c: F.when(c >= THRESHOLD, "pass").otherwise("warn")
    rows = [row("non_empty_input", hard(F.col("input_records")), F.col("input_records"), "> 0"), row("schema_validity_rate", soft(rate), F.round(rate, 4), ">= 0.95"), row("required_field_completeness", soft(F.col("least_completeness")), F.col("least_completeness"), ">= 0.95 for every required field")]
    rows += [row("curated_output", hard(F.col("curated_rows")), F.col("curated_rows"), "> 0")] if curated else []
    rows += [row("snapshot_freshness", F.lit("observed"), F.col("age_days"), None)]
    return metrics.select(F.inline(F.array(*rows)))


def process_reports(raw: DataFrame, as_of) -> dict[str, DataFrame]:
    """accepted, rejected, curated, metrics and checks of a raw snapshot of reports.

    A selected report that yields no pair is rejected late. ``as_of`` (a date) dates the snapshot.
    """
    # every record is parsed once; versions are told apart once, by their keys alone; counts ride on the writes
    store = Scratch(raw.sparkSession)
    told, seen = store.observed(validate_reports(raw), "validated", **_seen(REPORT_FIELDS))
    valid = told.where("size(reasons) = 0").drop("present")
    versions, kinds = store.observed(classified(valid.select("page", "index", "report_id", "version"), "report_id", "version", ["page", "index"]), "versions", **_kinds())
    chosen = valid.join(versions.where("winner").select("page", "index"), ["page", "index"], "left_semi").select(valid.columns)
    curated, rows = store.observed(curate_reports(chosen.drop("payload")), "curated", curated_rows=F.count(F.lit(1)))
    yielding = store.written(curated.groupBy("report_id").agg(F.first("fallbacks").alias("fallbacks")), "yielding")
    accepted = chosen.join(yielding, "report_id", "left_semi")
    late = chosen.join(yielding, "report_id", "left_anti").select("page", "index", "report_id", F.array(F.lit(NO_PAIR)).alias("reasons"), payload_digest())
    rejected = told.where("size(reasons) > 0").select("page", "index", "report_id", "reasons", payload_digest()).unionByName(late)
    # what no write can take along: reports that yield, different names
    n = chosen.join(yielding, "report_id", "left").agg(F.count("fallbacks").alias("accepted_reports"), F.count_if(F.col("fallbacks").isNull()).alias("late"), F.max(F.when(F.col("fallbacks").isNotNull(), F.to_date("report.receivedate", "yyyyMMdd"))).alias("newest_date"), F.coalesce(F.sum("fallbacks"), F.lit(0)).alias("drug_name_fallbacks"))
    unique = curated.agg(F.count_distinct("drug_name").alias("unique_drugs"), F.count_distinct("reaction").alias("unique_reactions"))
    metrics = n.crossJoin(unique).select(*_told(seen), *[F.lit(kinds[k]).cast("long").alias(f"{to}_removed") for k, to in (("followup", "followups"), ("duplicate", "duplicates"))], (F.lit(seen["input_records"] - seen["valid_records"]) + F.col("late")).alias("rejected_records"), "accepted_reports", "newest_date", F.lit(rows["curated_rows"]).cast("long").alias("curated_rows"), "unique_drugs", "unique_reactions", "drug_name_fallbacks", *_complete(seen, REPORT_FIELDS))
    metrics = metrics.withColumn("age_days", F.datediff(F.lit(as_of), "newest_date"))
    return {"accepted": accepted, "rejected": rejected, "curated": curated, "metrics": metrics, "checks": checks(metrics)}


def process_samples(raw: DataFrame, as_of) -> dict[str, DataFrame]:
    """accepted, rejected, curated, metrics and checks of a raw snapshot of environmental samples."""
    store = Scratch(raw.sparkSession)
    told, seen = store.observed(validate_samples(raw), "validated", **_seen(SAMPLE_FIELDS))
    valid = told.where("size(reasons) = 0").drop("present")
    versions, kinds = store.observed(classified(valid.select("page", "index", "record_id", "updated"), "record_id", "updated", ["page", "index"]), "versions", **_kinds())
    accepted = valid.join(versions.where("winner").select("page", "index"), ["page", "index"], "left_semi").select(valid.columns)
    curated = curate_samples(accepted)
    rejected = told.where("size(reasons) > 0").select("page", "index", "record_id", "reasons", payload_digest())
    n = curated.agg(F.count("*").alias("curated_rows"), F.count_distinct("site_id").alias("unique_sites"), F.count_distinct("state_territory").alias("states_and_territories"), F.count_if(F.col("concentration").isNull()).alias("missing_concentration"), F.max("sample_collect_date").alias("newest_date"))
    metrics = n.select(*_told(seen), F.lit(seen["input_records"] - seen["valid_records"]).cast("long").alias("rejected_records"), *[F.lit(kinds[k]).cast("long").alias(f"{to}_removed") for k, to in (("followup", "superseded"), ("duplicate", "duplicates"))], *n.columns, *_complete(seen, SAMPLE_FIELDS))
    metrics = metrics.withColumn("age_days", F.datediff(F.lit(as_of), "newest_date"))
    return {"accepted": accepted, "rejected": rejected, "curated": curated, "metrics": metrics, "checks": checks(metrics, curated=False)}


PROCESSORS = {"reports": process_reports, "samples": process_samples}


def processor(source: str):
    if source not in PROCESSORS:
        raise ValueError(f"no processor for source {source!r}")
    return PROCESSORS[source]
