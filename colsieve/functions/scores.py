"""Score arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Digits with a point and an exponent, infinity, nan: no hexadecimal numbers, no type letters behind.
DECIMAL = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"


def decimal_number(value: Column) -> Column:
    """Number of a column; text that is no decimal number is null. The cast alone would take literals like 12D."""
    return F.when(F.trim(value.cast("string")).rlike(DECIMAL), value.try_cast("double"))


def or_zero(value: Column) -> Column:
    """Number of a column; null, NaN and text that is no number become 0."""
    return or_default(value, 0.0)


def or_default(value: Column, default: float) -> Column:
    number = decimal_number(value)
    return F.when(number.isNull() | F.isnan(number), F.lit(float(default))).otherwise(number)


def unit_clip(value: Column, default: float = 0.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), or_default(value, default)))


def close(a: Column, b: Column, rel: float, abs_tol: float = 0.0, symmetric: bool = False) -> Column:
    """|a-b| <= tolerance; relative part by |b|, or by the larger of both if symmetric."""
    scale = F.greatest(F.abs(a), F.abs(b)) if symmetric else F.abs(b)
    if symmetric:
        return F.abs(a - b) <= F.greatest(F.lit(rel) * scale, F.lit(abs_tol))
    return F.abs(a - b) <= F.lit(abs_tol) + F.lit(rel) * scale
