"""The four candidate classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.guards import ensure_no_forbidden_features
from ..schema import MODEL_NAMES, TARGET
from ..scratch import materialise
from .boosting import fit_boosted, whole_waves  # noqa: F401  (tests take whole_waves from here)
from .features import (
    FEATURES_COLUMN,
    VECTOR_COLUMN,
    FeatureStats,
    fit_feature_stats,
    linear_encoder,
    pack_features,
    tree_encoder,
)
from .forest import fit_forest
from .newton import NewtonFit, fit_newton

RAW_SCORE = "p_raw"
WEIGHT = "__weight"
_SEED = 42


def penalised_logistic(rows: DataFrame, total_weight: float, maxIter: int = 2000, tol: float = 1e-10) -> NewtonFit:
    """L2 logistic regression of unit strength on rows with VECTOR_COLUMN, TARGET and WEIGHT, the intercept penalised as well.

    Newton steps end after a handful of passes. Where they do not descend, Spark ML's own solver takes over; it leaves the
    intercept free of the penalty, which matters less the more rows there are.
    """
    fitted = fit_newton(rows, VECTOR_COLUMN, TARGET, WEIGHT, RAW_SCORE, maxIter, tol)
    if fitted is not None:
        return fitted
    settings = dict(featuresCol=VECTOR_COLUMN, labelCol=TARGET, weightCol=WEIGHT, maxIter=maxIter, regParam=1.0 / total_weight, elasticNetParam=0.0)
    model = LogisticRegression(standardization=False, **settings).fit(rows)
    return NewtonFit([*map(float, model.coefficients), float(model.intercept)], model, maxIter)


def class_weights(train: DataFrame, balanced: bool) -> tuple[dict[int, float], float]:
    """Weight per class and their sum over all rows."""
    counts = {r[0]: r[1] for r in train.groupBy(TARGET).count().collect()}  # two classes
    rows = sum(counts.values())
    weights = {c: rows / (len(counts) * n) if balanced else 1.0 for c, n in counts.items()}
    return weights, float(sum(weights[c] * n for c, n in counts.items()))


def is_linear(name: str) -> bool:
    return name.startswith("logistic")


def encoder_of(spark: SparkSession, name: str, stats: FeatureStats, sample: DataFrame) -> PipelineModel:
    """The encoder a model reads; ``sample`` lends its schema."""
    return linear_encoder(sample, stats) if is_linear(name) else tree_encoder(spark, stats)


def packed_rows(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return pack_features(df, features).select(FEATURES_COLUMN, F.col(TARGET).cast("double").alias(TARGET), *keep)


def encoded_rows(df: DataFrame, features: Sequence[str], stats: FeatureStats, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Prepared rows as the vectors that the models ``names`` read, written once for all of them.

    There is one vector column for linear models and one for trees, each only where a model needs it. Partitions are of
    the size that Spark advises, so a small table is one task of every later job and a large one many.
    """
    rows, vectors = packed_rows(df, features, keep), []
    for name in ("logistic", "random_forest"):
        if any(is_linear(n) == is_linear(name) for n in names):
            encoded = encoder_of(df.sparkSession, name, stats, rows).transform(rows)
            rows = encoded.select(FEATURES_COLUMN, TARGET, *keep, *vectors, F.col(VECTOR_COLUMN).alias(vector_name(name)))
            vectors.append(vector_name(name))
    return materialise(rows.drop(FEATURES_COLUMN).hint("rebalance"))


def vector_name(name: str) -> str:
    return "__linear" if is_linear(name) else "__ordinal"


def fit_encoded(encoded: DataFrame, name: str, **overrides) -> Transformer:
    """Fit the classifier alone on ``encoded_rows``."""
    rows = encoded.select(F.col(vector_name(name)).alias(VECTOR_COLUMN), TARGET)
    if is_linear(name):
        weights, total = class_weights(rows, balanced=name == "logistic_balanced")
        rows = rows.withColumn(WEIGHT, F.when(F.col(TARGET) == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0)))
        return penalised_logistic(rows, total, **overrides).model
    if name == "random_forest":
        # Each row keeps its node of every tree: without that it walks down every tree again for each group of nodes.
        return fit_forest(rows, _tree(RandomForestClassifier, {**dict(numTrees=80, maxDepth=12, minInstancesPerNode=100, cacheNodeIds=True), **overrides}))
    return fit_boosted(rows, _tree(GBTClassifier, {**dict(maxIter=120, stepSize=0.08, maxDepth=5), **overrides}))


def predict_encoded(classifier: Transformer, encoded: DataFrame, name: str) -> DataFrame:
    """(target, p_raw) of ``encoded_rows``."""
    scored = classifier.transform(encoded.select(F.col(vector_name(name)).alias(VECTOR_COLUMN), TARGET))
    return scored.select(TARGET, _raw_score(scored).alias(RAW_SCORE))


def _raw_score(scored: DataFrame) -> Column:
    return F.col(RAW_SCORE) if RAW_SCORE in scored.columns else vector_to_array("probability")[1]


def fit_model(train: DataFrame, features: Sequence[str], name: str, stats: FeatureStats | None = None, **overrides) -> PipelineModel:
    """Fit encoder and classifier on prepared rows. ``overrides`` replace classifier settings."""
    ensure_no_forbidden_features(features)
    if name not in MODEL_NAMES:
        raise ValueError(f"unknown default model candidate: {name}")
    stats = stats or fit_feature_stats(train, features)
    encoder = encoder_of(train.sparkSession, name, stats, packed_rows(train, features))
    encoded = encoded_rows(train, features, stats, [name])
    return PipelineModel([*encoder.stages, fit_encoded(encoded, name, **overrides)])


def _tree(kind, settings: dict):
    return kind(featuresCol=VECTOR_COLUMN, labelCol=TARGET, maxBins=256, seed=_SEED, **settings)


def predict_raw(model: Transformer, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """``df`` with ``p_raw``, the uncalibrated probability of default.

    ``features`` packs prepared columns first; leave it out when the struct is already there. Any
    transformer will do that adds ``p_raw`` or a ``probability`` vector.
    """
    packed = pack_features(df, features) if features is not None else df
    scored = model.transform(packed)
    scored = scored.withColumn(RAW_SCORE, _raw_score(scored))
    kept = [c for c in df.columns if c != RAW_SCORE]
    return scored.select(*kept, RAW_SCORE)
