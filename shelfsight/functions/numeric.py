"""Numeric column helpers.

Sums of units, money, squares and quotients are kept in integers or decimals until the last
projection, so they do not depend on the order in which partitions are merged.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,0)"


def as_double(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def round_to(value: Column, digits: int) -> Column:
    """Round the scaled binary value, half away from zero, to ``digits`` places.

    ``F.round(x, n)`` rounds the decimal text of ``x`` instead, which differs on halves
    that have no exact binary form.
    """
    if digits == 0:
        return F.round(value, 0)
    scale = F.lit(float(10**digits))
    return F.round(value * scale, 0) / scale


def cents(amount: str) -> Column:
    """A column of two decimals as whole hundredths: exact, and far cheaper to add up than
    decimals wider than a machine word."""
    return (F.col(amount) * 100).cast("bigint")


def from_cents(total: Column | str) -> Column:
    """A sum of hundredths as a decimal again."""
    return (F.col(total) if isinstance(total, str) else total).cast("decimal(36,0)") * F.lit(
        Decimal("0.01")
    )


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Floating division that gives NULL for a zero denominator."""
    return as_double(numerator) / F.nullif(as_double(denominator), F.lit(0.0))


def percent(part: Column | str, whole: Column | str) -> Column:
    return F.lit(100.0) * as_double(part) / F.nullif(as_double(whole), F.lit(0.0))


def moments(value: str, prefix: str) -> list[Column]:
    """Count, sum and sum of squares of an integer column, as exact aggregates."""
    x = F.col(value).cast("bigint")
    return [
        F.count(x).alias(f"{prefix}_n"),
        F.sum(x).alias(f"{prefix}_sum"),
        F.sum(x * x).alias(f"{prefix}_sumsq"),
    ]


# A quotient is added up in units of 2**-30: its whole part and its rounded fraction.
FRACTION = float(1 << 30)


def quotient_sums(quotient: Column, prefix: str) -> list[Column]:
    """Count and sum of a double, the sum as two bigints that add up exactly: NULL is left out."""
    whole = F.floor(quotient)
    fraction = F.round((quotient - whole) * F.lit(FRACTION)).cast("bigint")
    return [
        F.sum(whole).alias(f"{prefix}_whole"),
        F.sum(fraction).alias(f"{prefix}_fraction"),
        F.count(quotient).alias(f"{prefix}_n"),
    ]


def quotient_total(prefix: str) -> Column:
    """The sum from merged quotient_sums, as a double."""
    parts = F.col(f"{prefix}_whole").cast(EXACT) * F.lit(1 << 30) + F.col(f"{prefix}_fraction").cast(EXACT)
    return as_double(parts) / F.lit(FRACTION)


def exact_sum(value: Column) -> Column:
    """Sum of doubles of any size in units of 2**-30, the same in every order of rows."""
    return as_double(F.sum(F.round(value * F.lit(FRACTION)).cast(EXACT))) / F.lit(FRACTION)


def mean_of(prefix: str) -> Column:
    return ratio(f"{prefix}_sum", f"{prefix}_n")


def sample_sd_of(prefix: str) -> Column:
    """Sample standard deviation from exact moments; NULL for fewer than two values."""
    n = F.col(f"{prefix}_n").cast(EXACT)
    total = F.col(f"{prefix}_sum").cast(EXACT)
    squares = F.col(f"{prefix}_sumsq").cast(EXACT)
    return F.sqrt(ratio(n * squares - total * total, n * (n - F.lit(1).cast(EXACT))))
