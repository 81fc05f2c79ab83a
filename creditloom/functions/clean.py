"""Column expressions that turn raw text into typed values. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# Characters removed by a full strip, Unicode blanks included; SQL ``trim`` alone removes blanks only.
_WHITESPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?i:inf|infinity))\s*$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITESPACE))


def clean_double(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Number, or NULL for anything that is not one.

    Text is checked before the cast: a plain cast would also take Java spellings such as ``12d``.
    NaN is a missing value and becomes NULL.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    return F.regexp_extract(c.cast("string"), _NUMBER, 1).try_cast("double")


def parse_percent(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """``"13.5%"`` -> 13.5; numbers pass through; bad text is NULL."""
    if isinstance(dtype, T.NumericType):
        return clean_double(c, dtype)
    return clean_double(F.replace(c, F.lit("%"), F.lit("")))


def parse_term_months(c: Column) -> Column:
    """First run of digits as a number, NULL without one."""
    return F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("int")


def parse_month(c: Column) -> Column:
    """``"Jan-2018"`` -> first day of the month; anything else is NULL."""
    return F.to_date(F.try_to_timestamp(c, F.lit("MMM-yyyy")))


def year_quarter(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value on one or both sides; NULL stays NULL (least/greatest would skip it)."""
    bounded = c
    if upper is not None:
        bounded = F.when(c > upper, F.lit(float(upper))).otherwise(bounded)
    if lower is not None:
        bounded = F.when(c < lower, F.lit(float(lower))).otherwise(bounded)
    return bounded


def log_amount(c: Column) -> Column:
    return F.log1p(clip(c, lower=0.0))


def risk_band(p: Column, low_max: float, medium_max: float) -> Column:
    """low / medium / high; a missing or NaN probability counts as high."""
    return F.when(p < low_max, "low").when(p < medium_max, "medium").otherwise("high")
