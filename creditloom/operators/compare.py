"""Candidate order, id-set verification and id-aligned scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def id_set_difference(expected: DataFrame, actual: DataFrame, id_column: str = "id") -> DataFrame:
    """Counts of ids missing from ``actual`` and unexpected in it, as one row.

    Ids are compared as text. Both sides are counted per id before they meet, in one shuffle.
    """
    marked = [
        df.select(F.col(id_column).cast("string").alias("id"), F.lit(side).alias("side"))
        for df, side in ((expected, 1), (actual, 2))
    ]
    seen = marked[0].unionByName(marked[1]).groupBy("id").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return seen.agg(
        F.count_if(F.col("hi") == 1).alias("missing"), F.count_if(F.col("lo") == 2).alias("unexpected")
    )


def ids_only_in(left: DataFrame, right: DataFrame, id_column: str = "id") -> DataFrame:
    """Distinct ids of ``left`` that ``right`` lacks."""
    text = F.col(id_column).cast("string").alias(id_column)
    return left.select(text).subtract(right.select(text))


def ensure_same_ids(expected: DataFrame, actual: DataFrame, id_column: str = "id") -> None:
    found = id_set_difference(expected, actual, id_column).first()
    if found["missing"] or found["unexpected"]:
        raise ValueError(
            "source CSV test split IDs do not match the locked bundle "
            f"(missing={found['missing']}, unexpected={found['unexpected']})"
        )


def score_alignment(df: DataFrame, scores: DataFrame, id_column: str = "id") -> DataFrame:
    """How scores that arrive as their own table fit the rows: one row of counts, in one shuffle.

    unscored: rows without a score row; repeated: ids with several score rows; stray: score rows without a row.
    """
    marked = [d.select(F.col(id_column).alias("id"), *[F.lit(int(side == i)).alias(f"n{i}") for i in (0, 1)]) for side, d in enumerate((df, scores))]
    per_id = marked[0].unionByName(marked[1]).groupBy("id").agg(F.sum("n0").alias("rows"), F.sum("n1").alias("scores"))
    # A missing id matches nothing, like in the join.
    matches = F.when(F.col("id").isNull(), 0).otherwise(F.col("scores"))
    return per_id.agg(
        F.coalesce(F.sum(F.when(matches == 0, F.col("rows"))), F.lit(0)).alias("unscored"),
        F.count_if(F.col("scores") > 1).alias("repeated"),
        F.coalesce(F.sum(F.when((F.col("rows") == 0) | F.col("id").isNull(), F.col("scores"))), F.lit(0)).alias("stray"),
    )


def attach_scores(df: DataFrame, scores: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows with the scores that arrive as their own table, joined on the id instead of on row position.

    Every row stays once; a row without a score has NULL. An id with several scores is an error.
    """
    repeated = score_alignment(df, scores, id_column).first()["repeated"]
    if repeated:
        raise ValueError(f"{repeated} ids have more than one score")
    return df.join(scores, id_column, "left")


def rank_key(candidates: DataFrame, model_order: Sequence[str]) -> list:
    """Sort key of candidates: calibration first, then loss, then discrimination, then listed order.

    A missing value is the worst value at its place.
    """
    worst = F.lit(float("inf"))
    low_is_good = [
        "mean_absolute_calibration_gap", "brier_score", "log_loss",
        "cv_mean_absolute_calibration_gap", "cv_mean_brier_score",
    ]
    position = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model_name"))
    return [
        *[F.coalesce(F.col(c), worst) for c in low_is_good],
        *[F.coalesce(-F.col(c), worst) for c in ("roc_auc", "pr_auc")],
        position,
    ]


def select_best(candidates: DataFrame, model_order: Sequence[str], selected_model: str | None = None) -> DataFrame:
    """The best candidate as one row, optionally among those of one pinned model.

    A running minimum of the key keeps this one aggregation however many candidates there are.
    """
    if selected_model is not None:
        candidates = candidates.filter(F.col("model_name") == selected_model)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank_key(candidates, model_order))])
    best = candidates.agg(F.min_by(F.struct(*candidates.columns), key).alias("best"))
    return best.filter(F.col("best").isNotNull()).select("best.*")


def comparison_table(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.col("brier_score").asc_nulls_last(), F.col("log_loss").asc_nulls_last())


def top_features(importance: DataFrame, k: int) -> DataFrame:
    return importance.orderBy(F.abs("importance").desc(), F.col("feature")).limit(k)
