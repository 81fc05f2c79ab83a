"""Lift per risk decile of exactly equal size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import TARGET
from ..scratch import local_rows
from .metrics import score_table
from .ordered import OrderedTable, ordered_table


def rank_bin(rank: Column, rows: Column, bins: int) -> Column:
    """Bin of a one-based rank when ``rows`` ranks are cut into ``bins`` parts."""
    return F.least(F.greatest(F.ceil(rank / rows * bins), F.lit(1)), F.lit(bins)).cast("int")


def risk_decile_lift(df: DataFrame, p: str = "p_default", y: str = TARGET, id_column: str = "id", bins: int = 10, scores: OrderedTable | None = None) -> DataFrame:
    """Highest scores first; equal scores are ordered by id. All bins are present, empty ones as zero.

    Scores whose rows all fall into one bin are counted from the score table. At most ``bins - 1``
    scores lie across a bin limit; only their rows are ordered by id.
    """
    scores = scores or score_table(df, p, y)
    first = F.col("total_n") - F.col("before_n") - F.col("n")  # rows with a higher score
    ranked = scores.running().select(
        "p", "n", "pos", "total_n",
        first.alias("above"),
        rank_bin(first + 1, F.col("total_n"), bins).alias("bin"),
        rank_bin(first + F.col("n"), F.col("total_n"), bins).alias("last_bin"),
    )
    whole = ranked.filter(F.col("bin") == F.col("last_bin"))
    split = ranked.filter(F.col("bin") != F.col("last_bin"))
    counted = whole.select("bin", "n", "pos")

    limits = [row.asDict() for row in split.select("p", "above", "total_n").collect()]  # at most bins - 1 rows
    if limits:
        above = local_rows(
            df.sparkSession,
            [(r["p"], r["above"], r["total_n"]) for r in limits],
            ["p", "above", "total_n"],
            ["double", "bigint", "bigint"],
        )
        rows = (
            df.select(F.col(p).cast("double").alias("p"), F.col(y).cast("int").alias("pos"), F.col(id_column).alias("id"))
            .na.drop(subset=["p", "pos"])
            .filter(F.col("p").isin(*[r["p"] for r in limits]))
            .withColumn("n", F.lit(1))
        )
        by_id = ordered_table(rows, ["id"], ["n"], ["p"]).running().drop("total_n")
        placed = by_id.join(F.broadcast(above), "p").select(
            rank_bin(F.col("above") + F.col("before_n") + 1, F.col("total_n"), bins).alias("bin"), "n", "pos"
        )
        counted = counted.unionByName(placed)

    empty = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"), F.lit(0).alias("n"), F.lit(0).alias("pos"))
    per_bin = counted.unionByName(empty).groupBy("bin").agg(F.sum("n").alias("count"), F.sum("pos").alias("defaults"))
    # From here on the table has exactly `bins` rows.
    everything = Window.partitionBy(F.lit(0))
    so_far = everything.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows, defaults = F.sum("count").over(everything), F.sum("defaults").over(everything)
    observed = F.when(F.col("count") > 0, F.col("defaults") / F.col("count")).otherwise(0.0)
    captured = F.sum("defaults").over(so_far)
    return (
        per_bin.withColumns({"__rows": rows, "__defaults": defaults, "__captured": captured})
        .filter(F.col("__rows") > 0)
        .select(
            F.col("bin").alias("predicted_risk_decile"),
            "count",
            observed.alias("observed_default_rate"),
            F.when(F.col("__defaults") > 0, observed / (F.col("__defaults") / F.col("__rows"))).alias(
                "lift_versus_portfolio_default_rate"
            ),
            F.when(F.col("__defaults") > 0, F.col("__captured") / F.col("__defaults"))
            .otherwise(0.0)
            .alias("cumulative_share_of_defaults_captured"),
        )
    )
