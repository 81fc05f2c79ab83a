"""Cleaning of whole loan rows: one projection each, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.clean import (
    clean_double,
    clip,
    log_amount,
    parse_month,
    parse_percent,
    parse_term_months,
    year_month,
    year_quarter,
)
from ..schema import CLIP_RANGES, FEATURES, LOG_FEATURES, NUMERIC_FEATURES, PERCENT_FEATURES, REJECTED_COLUMNS
from .target import construct_target


def numeric_feature(df: DataFrame, name: str) -> Column:
    """Typed, clipped and logged value of one raw numeric feature."""
    dtype = df.schema[name].dataType
    value = parse_percent(F.col(name), dtype) if name in PERCENT_FEATURES else clean_double(F.col(name), dtype)
    if name in CLIP_RANGES:
        value = clip(value, *CLIP_RANGES[name])
    if name in LOG_FEATURES:
        value = log_amount(value)
    return value


def prepare_loans(df: DataFrame, unknown: str = "list") -> DataFrame:
    """Resolved loans with target, term, issue period and model-ready numeric features.

    A missing issue month leaves year, quarter and month NULL.
    """
    return clean_loans(construct_target(df, unknown))


def clean_loans(df: DataFrame) -> DataFrame:
    """The cleaning part of ``prepare_loans``, for rows that need no target."""
    out = {name: numeric_feature(df, name) for name in NUMERIC_FEATURES if name in df.columns}
    if "term" in df.columns and "term_months" not in df.columns:
        out["term_months"] = parse_term_months(F.col("term"))
    df = df.withColumns(out) if out else df
    if "issue_d" in df.columns:
        df = df.withColumn("issue_dt", parse_month(F.col("issue_d")))
        issued = F.col("issue_dt")
        df = df.withColumns(
            {"issue_year": F.year(issued), "issue_quarter": year_quarter(issued), "issue_month": year_month(issued)}
        )
    return df


def scoring_features(df: DataFrame, features: Sequence[str] = FEATURES) -> Column:
    """Prepared features as one struct, so that the submitted columns stay as they are.

    The log is not idempotent; keeping prepared values apart makes it impossible to apply it twice.
    """
    return F.struct(
        *[
            (numeric_feature(df, name) if name in NUMERIC_FEATURES else F.col(name).cast("string")).alias(name)
            for name in features
            if name in df.columns
        ]
    )


def normalize_rejected(df: DataFrame) -> DataFrame:
    """Rejected applications with snake-case names and a parsed dti; they never get a target."""
    out = df.withColumnsRenamed({old: new for old, new in REJECTED_COLUMNS.items() if old in df.columns})
    if "dti" in out.columns:
        out = out.withColumn("dti", parse_percent(F.col("dti"), out.schema["dti"].dataType))
    return out
