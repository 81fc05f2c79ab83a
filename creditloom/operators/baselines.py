"""Historical-rate baselines and the long model-score table they are compared in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schema import TARGET
from ..scratch import materialise
from .metrics import metric_rows
from .ordered import ordered_table
from .split import in_splits


def group_rates(fit: DataFrame, column: str, target: str = TARGET) -> DataFrame:
    """Mean target per known value of ``column``."""
    return fit.filter(F.col(column).isNotNull()).groupBy(column).agg(F.avg(target).alias("rate"))


def group_rate_scores(fit: DataFrame, df: DataFrame, column: str, fallback: float, score: str = "p_default", target: str = TARGET) -> DataFrame:
    """Score each row with its group's historical rate; unseen or missing groups get the fallback.

    The rates are written first, so Spark knows their true size when it plans the join: it broadcasts
    them below its threshold and otherwise shuffles both sides, splitting skewed groups at run time.
    """
    rates = materialise(group_rates(fit, column, target).withColumnRenamed("rate", "__rate"))
    return (
        df.join(rates, column, "left").withColumn(score, F.coalesce("__rate", F.lit(float(fallback)))).drop("__rate")
    )


def base_rate(split_rows: DataFrame, fit: DataFrame, target: str = TARGET) -> float:
    """Default rate of the training split, else of the calibration split, else of the fitting rows."""
    rates = {r["split"]: r["default_rate"] for r in split_rows.select("split", "default_rate").collect()}
    for name in ("train", "calibration"):
        if rates.get(name) is not None:
            return float(rates[name])
    return float(fit.agg(F.avg(target)).first()[0])


def long_scores(df: DataFrame, scores: dict[str, str], target: str = TARGET) -> DataFrame:
    """(model_name, p, target) rows of several score columns."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model_name"), F.col(c).cast("double").alias("p")) for m, c in scores.items()]
    )
    return df.select(target, F.inline(pairs))


def comparison_metrics(long: DataFrame, roles: dict[str, str], target: str = TARGET) -> DataFrame:
    """Metric row per model; ``rows`` counts labels, scored or not.

    The rows are reduced once, to counts per model and score; rows without a score are one of these counts,
    so a model that scored nothing still has its row, with NULL metrics.
    """
    counts = materialise(
        long.filter(F.col(target).isNotNull())
        .select("model_name", F.nanvl("p", F.lit(None).cast("double")).alias("p"), F.col(target).cast("int").alias("y"))
        .groupBy("model_name", "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    )
    labels = counts.groupBy("model_name").agg(F.sum("n").alias("__labels"))
    scored = ordered_table(counts.filter(F.col("p").isNotNull()), ["p"], ["n", "pos"], ["model_name"])
    role = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    return labels.join(metric_rows(scored), "model_name", "left").select(
        "model_name",
        role[F.col("model_name")].alias("model_role"),
        F.col("__labels").alias("rows"),
        F.col("actual_default_rate").alias("observed_default_rate"),
        F.col("mean_predicted_default").alias("mean_predicted_default_rate"),
        "roc_auc", "pr_auc", "brier_score", "log_loss",
    )


def rate_baseline_scores(df: DataFrame, columns: Sequence[str], split_rows: DataFrame, target: str = TARGET) -> tuple[DataFrame, dict[str, str]]:
    """Test rows with one score column per rate baseline, and baseline name -> column.

    The base rate comes from the training split alone, the group rates from training and calibration.
    """
    fit, test = in_splits(df, "train", "calibration"), in_splits(df, "test")
    fallback = base_rate(split_rows, fit, target)
    scored = test.withColumn("p_base_rate", F.lit(fallback))
    names = {"base_rate": "p_base_rate"}
    for column in columns:
        if column in df.columns:
            scored = group_rate_scores(fit, scored, column, fallback, f"p_{column}_rate", target)
            names[f"{column}_historical_rate"] = f"p_{column}_rate"
    return scored, names
