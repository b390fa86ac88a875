"""Disproportionality statistics of 2x2 tables as Column expressions over cells a, b, c, d."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
CELLS = ("a", "b", "c", "d")


def corrected(prefix: str = "") -> tuple[Column, ...]:
    """The cells as doubles, 0.5 added to all four if any is 0."""
    cells = [F.col(prefix + x).cast("double") for x in CELLS]
    half = F.when(F.least(*cells) == 0, 0.5).otherwise(0.0)
    return tuple(x + half for x in cells)


def ror() -> Column:
    a, b, c, d = corrected()
    return (a * d) / (b * c)


def ror_error() -> Column:
    return F.sqrt(sum((1 / x for x in corrected()[1:]), 1 / corrected()[0]))


def prr() -> Column:
    a, b, c, d = corrected()
    return (a / (a + b)) / (c / (c + d))


def prr_error() -> Column:
    a, b, c, d = corrected()
    return F.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))


def bounds(estimate: Column, error: Column) -> tuple[Column, Column]:
    return F.exp(F.ln(estimate) - Z * error), F.exp(F.ln(estimate) + Z * error)


def chi_square() -> Column:
    """Pearson's statistic of the uncorrected cells, in doubles: products of counts leave 64 bits."""
    a, b, c, d = (F.col(x).cast("double") for x in CELLS)
    total, product = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    difference = a * d - b * c
    return F.when((total == 0) | (product == 0), 0.0).otherwise(total * difference * difference / F.nullif(product, F.lit(0.0)))
