"""Probability calibration, fitted on score tables."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from ..functions.clean import clip
from ..operators.ordered import PART, OrderedTable
from ..schema import TARGET
from ..scratch import materialise
from .features import VECTOR_COLUMN
from .models import RAW_SCORE, WEIGHT, penalised_logistic


#: Neighbouring runs whose blocks meet in one task.
MERGED = 16


@dataclass
class Calibrator:
    """``isotonic`` holds a fitted model, ``sigmoid`` two numbers, ``identity`` nothing."""

    method: str
    model: IsotonicRegressionModel | None = None
    slope: float | None = None
    offset: float | None = None

    def apply(self, df: DataFrame, out: str = "p_default", raw: str = RAW_SCORE) -> DataFrame:
        """Add the calibrated probability in [0, 1]."""
        if self.method == "isotonic":
            scored = self.model.setFeaturesCol(raw).setPredictionCol("__calibrated").transform(df)
            return scored.withColumn(out, clip(F.col("__calibrated"), 0.0, 1.0)).drop("__calibrated")
        if self.method == "sigmoid":
            margin = F.lit(self.slope) * F.col(raw) + F.lit(self.offset)
            return df.withColumn(out, 1 / (1 + F.exp(-margin)))
        return df.withColumn(out, clip(F.col(raw), 0.0, 1.0))


def pooled_blocks(scores: OrderedTable) -> DataFrame:
    """(low, high, n, pos): blocks of neighbouring scores whose rates rise from block to block, pooled as isotonic regression does.

    Rates that fall are pooled inside each range partition first, then inside ever larger runs of MERGED neighbouring partitions, so only
    blocks travel, and a task holds those of one run. A table of one range partition is left to the regression as it is.
    """
    numbers = sorted({p[PART] for p in scores.parts})
    blocks = scores.table.select(F.col(PART).alias("run"), F.col("p").alias("low"), F.col("p").alias("high"), "n", "pos")
    if len(numbers) <= 1:
        return blocks.drop("run")
    runs, width = max(numbers) + 1, 1
    while True:
        grouped = blocks.withColumn("run", F.floor(F.col("run") / width).cast("int")).groupBy("run")
        blocks = materialise(grouped.applyInPandas(_pooled, "run int, low double, high double, n bigint, pos bigint"))
        runs, width = -(-runs // width), MERGED
        if runs == 1:
            return blocks.drop("run")


def _pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Adjacent blocks whose rates do not rise, made one; compared as whole numbers."""
    kept: list[list] = []
    for low, high, n, pos in blocks.sort_values("low")[["low", "high", "n", "pos"]].itertuples(index=False):
        while kept and kept[-1][3] * n >= pos * kept[-1][2]:
            before = kept.pop()
            low, n, pos = before[0], before[2] + n, before[3] + pos
        kept.append([low, high, n, pos])
    found = pd.DataFrame(kept, columns=["low", "high", "n", "pos"])
    found.insert(0, "run", blocks["run"].iloc[0])
    return found


def fit_calibrator(scores: OrderedTable, method: str = "isotonic") -> Calibrator:
    """Fit on distinct scores weighted by their rows: the same optimum as on the rows themselves."""
    if method not in ("identity", "sigmoid", "isotonic"):
        raise ValueError(f"unknown calibration method: {method}")
    total = scores.totals.get((), {"n": 0, "pos": 0})
    if not 0 < total["pos"] < total["n"]:
        raise ValueError("calibration requires both classes")
    if method == "identity":
        return Calibrator(method)
    if method == "isotonic":
        blocks = pooled_blocks(scores)
        # Both ends of a block have its rate; a block of one score is one point.
        ends = F.array_distinct(F.array("low", "high"))
        points = blocks.select(
            F.explode(ends).alias(RAW_SCORE), (F.col("pos") / F.col("n")).alias(TARGET), (F.col("n") / F.size(ends)).alias(WEIGHT)
        )
        model = IsotonicRegression(featuresCol=RAW_SCORE, labelCol=TARGET, weightCol=WEIGHT).fit(points)
        return Calibrator(method, model=model)
    pairs = F.array(
        F.struct(F.lit(1.0).alias(TARGET), F.col("pos").cast("double").alias(WEIGHT)),
        F.struct(F.lit(0.0).alias(TARGET), (F.col("n") - F.col("pos")).cast("double").alias(WEIGHT)),
    )
    points = scores.table.select("p", F.inline(pairs)).filter(F.col(WEIGHT) > 0)
    vectors = VectorAssembler(inputCols=["p"], outputCol=VECTOR_COLUMN).transform(points)
    slope, offset = penalised_logistic(vectors, float(total["n"])).coefficients
    return Calibrator(method, slope=slope, offset=offset)
