"""Column functions that normalise source fields (no Python runs on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code lists of the report format.
ROLES = {"1": "primary_suspect", "2": "secondary_suspect", "3": "concomitant", "4": "interacting"}
SEXES = {"0": "unknown", "1": "male", "2": "female"}
AGE_UNITS = {"800": 1 / 8760, "801": 1 / 365, "802": 1 / 52.1429, "803": 1 / 12, "804": 1.0, "805": 10.0}
BANDS = [(2, "0-1"), (18, "2-17"), (45, "18-44"), (65, "45-64")]
#: White space as Python sees it: Java's \s leaves out no-break and typographic spaces.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"


def normalize_term(c: Column) -> Column:
    """Outer white space off, inner runs to one space, upper case."""
    return F.upper(F.trim(F.regexp_replace(c, SPACES, " ")))


def _first_name(names: Column) -> Column:
    cleaned = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), normalize_term), lambda x: x.isNotNull() & (x != ""))))
    return F.when(F.size(cleaned) > 0, F.element_at(cleaned, 1))


def normalize_drug_name(generic: Column, substance: Column, brand: Column, product: Column) -> tuple[Column, Column]:
    """(name, where it comes from): the alphabetically first name of the first list that has any, else the product text."""
    lists = {"openfda_generic_name": _first_name(generic), "openfda_substance_name": _first_name(substance), "openfda_brand_name": _first_name(brand)}
    own = F.nullif(normalize_term(product), F.lit(""))
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in lists.items()], F.when(own.isNotNull(), F.lit("reported_medicinal_product")), F.lit("missing"))
    return F.coalesce(*lists.values(), own), source


def _mapped(c: Column, values: dict[str, str], other: str) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(c == k, v)
    return out.otherwise(other)


def drug_role(c: Column) -> Column:
    return _mapped(c, ROLES, "unknown")


def patient_sex(c: Column) -> Column:
    return _mapped(F.coalesce(F.nullif(c, F.lit("")), F.lit("0")), SEXES, "unknown")


def serious(c: Column) -> Column:
    """True for 1, false for 2, else null."""
    return F.when(c == "1", True).when(c == "2", False)


def age_years(value: Column, unit: Column) -> Column:
    """Age in years, null where it can't be read or lies outside 0 to 130."""
    factor = F
    for code, years in AGE_UNITS.items():
        factor = factor.when(unit == code, F.lit(years))
    years = value.try_cast("double") * factor
    return F.when((years >= 0) & (years <= 130), years)


def age_band(years: Column) -> Column:
    """The age group of unrounded years."""
    out = F.when(years.isNull(), "unknown")
    for limit, name in BANDS:
        out = out.when(years < limit, name)
    return out.otherwise("65+")


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def quarter_end(day: Column) -> Column:
    """Last calendar day of the quarter that ``day`` lies in."""
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def quarter_ordinal(label: Column) -> Column:
    return F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, -1, 1).cast("int") - 1


def tokens(c: Column) -> Column:
    """Different runs of lower-case letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0))


def stratum(age_group: Column, sex: Column, year: Column) -> Column:
    return F.concat(F.lit("age="), age_group, F.lit("|sex="), sex, F.lit("|year="), year.cast("string"))


def brief_key(drug: Column, event: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.upper(drug), F.lit("\0"), F.upper(event)), 256), 1, 20)
