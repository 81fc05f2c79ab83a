"""Chronological split by whole dates, its guards and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..schema import SPLIT_RATIOS, SPLITS, TARGET
from ..scratch import local_rows
from .ordered import counted, cuts_at


def date_quality(df: DataFrame, date_column: str = "issue_dt") -> DataFrame:
    """Row count, missing dates and distinct dates as one row."""
    return _per_date(df, date_column).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("n"))), F.lit(0)).alias("missing_dates"),
        F.count("d").alias("distinct_dates"),
    )


def _per_date(df: DataFrame, date_column: str) -> DataFrame:
    return df.groupBy(F.col(date_column).alias("d")).agg(F.count("*").alias("n"))


def _rows_before(df: DataFrame, date_column: str) -> DataFrame:
    """Dates with their rows ``n`` and the rows of all earlier dates ``before_n``."""
    if isinstance(df.schema[date_column].dataType, T.DateType):
        # Distinct calendar days are bounded by the calendar, so one window over them is small.
        everything = Window.partitionBy(F.lit(0))
        earlier = everything.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
        return _per_date(df, date_column).withColumns(
            {
                "before_n": F.coalesce(F.sum(F.when(F.col("d").isNotNull(), F.col("n"))).over(earlier), F.lit(0)),
                "total_n": F.sum("n").over(everything),
            }
        )
    return counted(df.select(F.col(date_column).alias("d")), ["d"]).running()


def split_cuts(df: DataFrame, date_column: str = "issue_dt", ratios: Sequence[float] = SPLIT_RATIOS) -> list | None:
    """First date of the 2nd, 3rd and 4th split (None where no date reaches it); None for no rows.

    A date belongs to the split whose number is the count of targets that the rows of all earlier
    dates already reach; that number only grows with the date, so three cut dates say it all.
    """
    if date_column not in df.columns:
        raise ValueError(f"missing split date column: {date_column}")
    if round(sum(ratios), 8) != 1:
        raise ValueError("split ratios must sum to 1")
    shares = [sum(ratios[: i + 1]) for i in range(len(ratios) - 1)]
    targets = [F.floor(F.col("total_n") * F.lit(float(s))) for s in shares]
    found = (
        _rows_before(df, date_column)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            F.count("d").alias("dates"),
            *[F.min(F.when(F.col("before_n") >= t, F.col("d"))).alias(f"cut{i}") for i, t in enumerate(targets)],
        )
        .first()
    )
    if found["missing"]:
        raise ValueError(f"{date_column} has {found['missing']} missing values")
    if found["rows"] == 0:
        return None
    if found["dates"] < 4:
        raise ValueError("chronological split requires at least 4 distinct issue dates")
    return [found[f"cut{i}"] for i in range(len(targets))]


def split_chronological(df: DataFrame, date_column: str = "issue_dt", ratios: Sequence[float] = SPLIT_RATIOS) -> DataFrame:
    """Add ``split``. Whole dates stay together and no date of a later split precedes an earlier one.

    The cut dates are found in one aggregation over dates; the result is then a plain projection
    with three literals, without a join or shuffle.
    """
    cuts = split_cuts(df, date_column, ratios)
    label = F.lit(SPLITS[0])
    for name, cut in zip(SPLITS[1:], cuts or []):
        if cut is not None:
            label = F.when(F.col(date_column) >= F.lit(cut), name).otherwise(label)
    return df.withColumn("split", label)


def in_splits(df: DataFrame, *names: str) -> DataFrame:
    return df.filter(F.col("split").isin(*names))


def split_summary(df: DataFrame, target: str = TARGET, date_column: str = "issue_dt") -> DataFrame:
    """Rows, default rate and first and last date of all four splits; empty splits have zero rows."""
    names = local_rows(df.sparkSession, [(s,) for s in SPLITS], ["split"], ["string"])
    columns = [F.count("*").alias("rows")]
    columns.append((F.avg(target) if target in df.columns else F.lit(None).cast("double")).alias("default_rate"))
    for name, f in (("date_min", F.min), ("date_max", F.max)):
        columns.append((f(date_column) if date_column in df.columns else F.lit(None).cast("date")).alias(name))
    per_split = df.groupBy("split").agg(*columns)
    return names.join(per_split, "split", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))


def split_manifest(summary: DataFrame | Sequence[dict]) -> dict:
    """Row counts, default rates and date ranges per split, from the four rows of a split summary."""
    found = [r.asDict() for r in summary.collect()] if isinstance(summary, DataFrame) else summary
    rows = {r["split"]: r for r in found}
    iso = lambda d: d.isoformat() if d is not None else None
    return {
        "row_counts": {s: rows[s]["rows"] for s in SPLITS},
        "default_rates": {s: rows[s]["default_rate"] for s in SPLITS},
        "date_ranges": {s: {"min": iso(rows[s]["date_min"]), "max": iso(rows[s]["date_max"])} for s in SPLITS},
    }


def test_ids(df: DataFrame) -> DataFrame:
    return in_splits(df, "test").select(F.col("id").cast("string").alias("id"))


def split_count_report(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Labelled rows, defaults and non-defaults per split and issue year; a missing year is a group."""
    return (
        df.groupBy("split", "issue_year")
        .agg(F.count(target).alias("rows"), F.coalesce(F.sum(target), F.lit(0)).alias("defaults"))
        .withColumn("non_defaults", F.col("rows") - F.col("defaults"))
    )


def fold_count(rows: int) -> int:
    return min(4, max(2, rows // 10))


def fold_blocks(df: DataFrame, date_column: str = "issue_dt", id_column: str = "id") -> tuple[DataFrame, int]:
    """Add ``block`` for expanding time-series folds; returns the rows and the number of folds.

    In (date, id) order the last ``folds * block size`` rows form the test blocks 1..folds, and all
    earlier rows are block 0. Fold ``i`` tests block ``i`` and trains on the blocks before it. With
    fewer than 8 rows or 4 dates there are no folds.
    """
    quality = date_quality(df, date_column).first()
    rows = quality["rows"]
    if rows < 8 or quality["distinct_dates"] < 4:
        return df.withColumn("block", F.lit(0)), 0
    folds = fold_count(rows)
    size = rows // (folds + 1)
    starts = [rows - (folds - i) * size for i in range(folds)]
    cuts = cuts_at(df, date_column, id_column, starts)
    reached = [F.when(cuts[s].reached(F.col(date_column), F.col(id_column)), 1).otherwise(0) for s in starts]
    return df.withColumn("block", sum(reached, F.lit(0))), folds


def fold_sizes(blocked: DataFrame, folds: int, target: str = TARGET) -> DataFrame:
    """Training and test rows and the classes seen in each, per fold."""
    per_block = blocked.groupBy("block", F.col(target).alias("y")).agg(F.count("*").alias("n"))
    # A handful of rows: every block takes part in its own fold and in all later ones.
    fold = F.explode(F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(folds)))
    joined = per_block.withColumn("fold", fold)
    training = F.col("block") < F.col("fold")
    return joined.groupBy("fold").agg(
        F.sum(F.when(training, F.col("n"))).alias("train_rows"),
        F.sum(F.when(~training, F.col("n"))).alias("validation_rows"),
        F.count_distinct(F.when(training, F.col("y"))).alias("train_classes"),
        F.count_distinct(F.when(~training, F.col("y"))).alias("validation_classes"),
    )
