"""Logistic regression by Newton steps, each a weighted least-squares fit from grouped second moments.

The loss is the one of the reference's solver: the log loss of all rows plus half the squared length of all coefficients,
the intercept's included. A Newton step is the least-squares fit of the working response with the weights p (1 - p), whose
moments Spark ML sums in one pass over the rows; the driver solves one system as large as the features, once a step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Features that the normal equations of Spark ML take.
MOST_FEATURES = 4096
#: Margins beyond this are cut in the weights of a step, where p (1 - p) would vanish.
_FAR = 30.0


@dataclass
class NewtonFit:
    """``coefficients``, the intercept last; ``model`` adds the margin's probability as a column."""

    coefficients: Sequence[float]
    model: Transformer
    steps: int


def fit_newton(rows: DataFrame, vector: str, label: str, weight: str, out: str, steps: int = 100, tolerance: float = 1e-10) -> NewtonFit | None:
    """Minimise the penalised log loss over ``rows`` (vector, label 0 or 1, weight), which are read twice a step.

    None where a step makes the loss worse, or where there are more than MOST_FEATURES: another solver has to take over.
    """
    first = rows.select(vector).first()
    if first is None or first[0].size > MOST_FEATURES:
        return None
    size = first[0].size
    # Half the square of the intercept is what a row without features, response 0 and weight 1 adds to the least squares.
    penalty = rows.sparkSession.createDataFrame([(Vectors.sparse(size, [], []), 1.0, 0.0)], StructType([
        StructField("__x", VectorUDT()), StructField("__weight", DoubleType()), StructField("__response", DoubleType())
    ]))
    base = rows.select(F.col(vector).alias("__x"), F.col(label).cast("double").alias("__y"), F.col(weight).alias("__w"))
    model, coefficients, before = None, [0.0] * (size + 1), float("inf")
    for number in range(1, steps + 1):
        known = base.withColumn("__margin", F.lit(0.0)) if model is None else model.transform(base)
        cut = F.greatest(F.least("__margin", F.lit(_FAR)), F.lit(-_FAR))
        known = known.withColumn("__p", 1 / (1 + F.exp(-cut))).withColumn("__s", F.col("__p") * (1 - F.col("__p")))
        # log(1 + e^-t) without overflow, t being the margin towards the label.
        towards = (2 * F.col("__y") - 1) * F.col("__margin")
        loss = F.log1p(F.exp(-F.abs(towards))) + F.greatest(-towards, F.lit(0.0))
        share, response = F.col("__w") * F.col("__s"), cut + (F.col("__y") - F.col("__p")) / F.col("__s")
        total, mean, square, lost = known.agg(F.sum(share), F.sum(share * response), F.sum(share * response * response), F.sum(F.col("__w") * loss)).first()
        lost += sum(c * c for c in coefficients) / 2
        if lost > before + 1e-9 * max(1.0, abs(before)):
            return None
        before = lost
        working = known.select("__x", share.alias("__weight"), response.alias("__response")).unionByName(penalty)
        # Spark ML divides the penalty by the sum of weights, and by the deviation of the response, which it scales to one.
        deviation = max(square / (total + 1) - (mean / (total + 1)) ** 2, 0.0) ** 0.5
        if deviation == 0:
            return None
        least_squares = LinearRegression(
            featuresCol="__x", labelCol="__response", weightCol="__weight", predictionCol="__margin", solver="normal",
            standardization=False, elasticNetParam=0.0, regParam=deviation / (total + 1),
        )
        model = least_squares.fit(working)
        found = [*map(float, model.coefficients), float(model.intercept)]
        moved = max(abs(a - b) for a, b in zip(found, coefficients))
        coefficients = found
        if moved <= tolerance * max(1.0, max(map(abs, coefficients))):
            break
    probability = SQLTransformer(statement=f"SELECT *, 1D / (1D + exp(-`__margin`)) AS `{out}` FROM __THIS__")
    return NewtonFit(coefficients, PipelineModel([model.setFeaturesCol(vector), probability]), number)
