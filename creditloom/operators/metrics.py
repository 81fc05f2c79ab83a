"""Exact probability metrics from score tables.

A score table holds one row per distinct score with its row and default counts, so every metric
below is a sum over distinct scores; rows are read and shuffled once, after a map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import TARGET
from ..scratch import local_rows
from .ordered import OrderedTable, ordered_table
from .quantiles import quantile_bin, quantile_edges, quantiles_of

# Probabilities are kept this far from 0 and 1 before a logarithm (machine epsilon of a double).
LOG_EPSILON = 2.220446049250313e-16

# Fixed order of the columns of a metric row.
METRIC_COLUMNS = ("roc_auc", "pr_auc", "brier_score", "log_loss", "mean_predicted_default", "actual_default_rate")


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, F.lit(2)))


def log_loss_term(p: Column) -> Column:
    return F.ln(F.least(F.greatest(p, F.lit(LOG_EPSILON)), F.lit(1.0 - LOG_EPSILON)))


def score_counts(df: DataFrame, p: str = "p_default", y: str = TARGET, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with their counts; rows without label or score are left out."""
    return (
        df.select(*by, F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y"))
        .na.drop(subset=["p", "y"])
        .groupBy(*by, "p")
        .agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    )


def score_table(df: DataFrame, p: str = "p_default", y: str = TARGET, by: Sequence[str] = ()) -> OrderedTable:
    return ordered_table(score_counts(df, p, y, by), ["p"], ["n", "pos"], by)


def merge_scores(counts: DataFrame, by: Sequence[str] = ()) -> OrderedTable:
    """Score table from counts whose scores were mapped to new values (for example calibrated)."""
    merged = counts.groupBy(*by, "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return ordered_table(merged, ["p"], ["n", "pos"], by)


def metric_rows(scores: OrderedTable) -> DataFrame:
    """Rows, mean score, observed rate, ROC-AUC, average precision, Brier score and log loss per group.

    ROC-AUC counts ties as one half. Average precision is the step sum over thresholds, not a
    trapezoid. Both, and the log loss, are NULL without both classes.
    """
    rows = scores.running()
    n, pos, p = F.col("n"), F.col("pos"), F.col("p")
    neg = n - pos
    positives, negatives = F.col("total_pos"), F.col("total_n") - F.col("total_pos")
    above = positives - F.col("before_pos") - pos
    caught = positives - F.col("before_pos")
    flagged = F.col("total_n") - F.col("before_n")
    sums = rows.groupBy(*scores.by).agg(
        F.max("total_n").alias("rows"),
        F.max(positives).alias("__p"),
        F.max(negatives).alias("__n"),
        F.sum(p * n).alias("__sum_p"),
        F.sum(pos * F.pow(1 - p, F.lit(2)) + neg * F.pow(p, F.lit(2))).alias("__sq"),
        F.sum(-(pos * log_loss_term(p) + neg * log_loss_term(1 - p))).alias("__ll"),
        F.sum(neg.cast("double") * (above + pos / 2)).alias("__pairs"),
        F.sum(pos.cast("double") * (caught / flagged)).alias("__steps"),
    )
    both = (F.col("__p") > 0) & (F.col("__n") > 0)
    total = F.col("rows")
    return sums.filter(total.isNotNull()).select(
        *scores.by,
        "rows",
        F.when(both, F.col("__pairs") / (F.col("__p").cast("double") * F.col("__n"))).alias("roc_auc"),
        F.when(both, F.col("__steps") / F.col("__p")).alias("pr_auc"),
        (F.col("__sq") / total).alias("brier_score"),
        F.when(both, F.col("__ll") / total).alias("log_loss"),
        (F.col("__sum_p") / total).alias("mean_predicted_default"),
        (F.col("__p") / total).alias("actual_default_rate"),
    )


def calibration_bins(scores: OrderedTable, bins: int = 10, edge_digits: int | None = None) -> DataFrame:
    """Quantile bins of the score with count, mean score, observed rate and their gap."""
    edges = quantile_edges(scores, bins, "n", edge_digits)
    table = scores.table
    if scores.by:
        values = [(*g, e[:-1]) for g, e in edges.items()]
        types = [*[table.schema[b].dataType.simpleString() for b in scores.by], "array<double>"]
        per_group = local_rows(table.sparkSession, values, [*scores.by, "__edges"], types)
        # One row per group (a model or a named subset) with at most bins + 1 numbers.
        binned = table.join(F.broadcast(per_group), list(scores.by)).withColumn(
            "decile", F.greatest(F.lit(1), F.size(F.filter("__edges", lambda e: e < F.col("p"))))
        )
    else:
        binned = table.withColumn("decile", quantile_bin(F.col("p"), edges.get((), [])))
    return _reliability(binned, [*scores.by, "decile"])


def _reliability(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return (
        counts.groupBy(*by)
        .agg(
            F.sum("n").alias("count"),
            (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_predicted_default"),
            (F.sum("pos") / F.sum("n")).alias("observed_default_rate"),
        )
        .withColumn(
            "absolute_calibration_gap", F.abs(F.col("mean_predicted_default") - F.col("observed_default_rate"))
        )
    )


def mean_calibration_gap(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the bin gaps."""
    return bins.groupBy(*by).agg(F.avg("absolute_calibration_gap").alias("mean_absolute_calibration_gap"))


def calibration_summary(df: DataFrame, p: str = "p_default", y: str = TARGET, bins: int = 10, edge_digits: int | None = None) -> DataFrame:
    """One row with the metrics and the reliability bins as an array."""
    return summary_of(score_table(df, p, y), bins, edge_digits)


def summary_of(scores: OrderedTable, bins: int = 10, edge_digits: int | None = None) -> DataFrame:
    if not scores.parts:
        raise ValueError("there are no rows with score and target to summarise")
    deciles = calibration_bins(scores, bins, edge_digits)
    columns = ["decile", "count", "mean_predicted_default", "observed_default_rate", "absolute_calibration_gap"]
    by = list(scores.by)
    # At most `bins` structs per group reach one array.
    packed = deciles.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("deciles"))
    names = [*by, "rows", *METRIC_COLUMNS, "deciles"]
    stacked = metric_rows(scores).unionByName(packed, allowMissingColumns=True)
    return stacked.groupBy(*by).agg(*[F.max(c).alias(c) for c in names if c not in by])


def metric_row(summary: DataFrame, model_name: str, model_role: str) -> DataFrame:
    """Comparison row of one model from its summary."""
    return summary.select(
        F.lit(model_name).alias("model_name"),
        F.lit(model_role).alias("model_role"),
        "rows",
        F.col("actual_default_rate").alias("observed_default_rate"),
        F.col("mean_predicted_default").alias("mean_predicted_default_rate"),
        "roc_auc", "pr_auc", "brier_score", "log_loss",
    )


def risk_thresholds(scores: OrderedTable) -> dict[str, float]:
    """Tercile limits of the scores, six digits."""
    low, medium = quantiles_of(scores, {(): [1 / 3, 2 / 3]})[()]
    return {"low_max": round(low, 6), "medium_max": round(medium, 6)}


def group_reliability(df: DataFrame, group_columns: Sequence[str], p: str = "p_default", y: str = TARGET) -> DataFrame:
    """Count, mean score, observed rate and Brier score per value of each grouping column.

    One pass over the data for all columns: each row meets its groups as (dimension, value) pairs,
    which are combined before the shuffle. Rows without a value are left out of that dimension.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in group_columns])
    scored = df.select(
        *group_columns, F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("y")
    ).na.drop(subset=["p", "y"])
    return (
        scored.select("p", "y", F.inline(pairs))
        .na.drop(subset=["value"])
        .groupBy("dimension", "value")
        .agg(
            F.count("*").alias("count"),
            F.avg("p").alias("mean_predicted_default"),
            F.avg("y").alias("observed_default_rate"),
            brier(F.col("p"), F.col("y")).alias("brier_score"),
        )
    )
