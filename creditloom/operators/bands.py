"""Quartile bands of the loan amount and subgroup reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import TARGET
from .metrics import group_reliability
from .ordered import counted
from .quantiles import quantile_bin, quantile_edges, unpivot_values

MISSING_BAND = "missing"


def amount_column(df: DataFrame) -> str | None:
    return next((c for c in ("loan_amnt", "amount_requested") if c in df.columns), None)


def amount_bands(df: DataFrame, column: str | None = None, bins: int = 4, edge_digits: int | None = None) -> DataFrame:
    """Add ``band`` (number), ``band_lo`` and ``band_hi``; a missing amount has no band."""
    column = column or amount_column(df)
    if column is None:
        raise ValueError("no loan amount column")
    ordered = counted(unpivot_values(df, [column], "double"), ["value"], ["feature"])
    edges = quantile_edges(ordered, bins, "n", edge_digits).get((column,), [])
    number = quantile_bin(F.col(column).cast("double"), edges)
    lows, highs = edges[:-1] or edges, edges[1:] or edges
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("band")) if values else F.lit(None).cast("double")
    return df.withColumn("band", number).withColumns({"band_lo": pick(lows), "band_hi": pick(highs)})


def subgroup_reliability(df: DataFrame, p: str = "p_default", y: str = TARGET, edge_digits: int | None = None) -> DataFrame:
    """Reliability by term, grade, sub-grade and amount band, in one pass over the scored rows."""
    columns = [c for c in ("term_months", "grade", "sub_grade") if c in df.columns]
    amount = amount_column(df)
    if amount is not None:
        label = F.coalesce(F.col("band").cast("string"), F.lit(MISSING_BAND))
        df = amount_bands(df, amount, edge_digits=edge_digits).withColumn(f"{amount}_band", label)
        columns.append(f"{amount}_band")
    return group_reliability(df, columns, p, y)
