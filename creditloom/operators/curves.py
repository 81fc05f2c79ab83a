"""ROC and precision-recall points from a score table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import local_rows
from .ordered import OrderedTable


def _both_classes(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("total_pos") > 0) & (F.col("total_n") > F.col("total_pos")))


def roc_points(scores: OrderedTable) -> DataFrame:
    """False and true positive rate per threshold; empty without both classes.

    A threshold is left out when its counts equal those of the next lower score, because the curve
    runs straight through it. The highest and lowest scores always stay, and the curve starts at
    (0, 0) with an infinite threshold.
    """
    rows = _both_classes(scores.running())
    neg, total_neg = F.col("n") - F.col("pos"), F.col("total_n") - F.col("total_pos")
    lower_neg = F.col("previous_n") - F.col("previous_pos")
    corner = (
        F.col("previous_n").isNull()
        | (F.col("before_n") + F.col("n") == F.col("total_n"))
        | (lower_neg != neg)
        | (F.col("previous_pos") != F.col("pos"))
    )
    points = rows.filter(corner).select(
        *scores.by,
        ((total_neg - (F.col("before_n") - F.col("before_pos"))) / total_neg).alias("fpr"),
        ((F.col("total_pos") - F.col("before_pos")) / F.col("total_pos")).alias("tpr"),
        F.col("p").alias("threshold"),
    )
    start = _ends(scores).select(
        *scores.by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return points.unionByName(start)


def pr_points(scores: OrderedTable) -> DataFrame:
    """Precision and recall per threshold and the end point (1, 0, NULL); empty without both classes."""
    caught = F.col("total_pos") - F.col("before_pos")
    points = _both_classes(scores.running()).select(
        *scores.by,
        (caught / (F.col("total_n") - F.col("before_n"))).alias("precision"),
        (caught / F.col("total_pos")).alias("recall"),
        F.col("p").alias("threshold"),
    )
    end = _ends(scores).select(
        *scores.by,
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"),
    )
    return points.unionByName(end)


def _ends(scores: OrderedTable) -> DataFrame:
    """One row per group that has both classes."""
    groups = [(*g, 1) for g, t in scores.totals.items() if 0 < t["pos"] < t["n"]]
    types = [*[scores.table.schema[b].dataType.simpleString() for b in scores.by], "int"]
    return local_rows(scores.table.sparkSession, groups, [*scores.by, "__one"], types)
