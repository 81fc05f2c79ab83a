"""Feature encoding: exact imputation, scaling, one-hot and ordinal codes as Spark ML stages.

Models read prepared features from one struct column, ``features``; whatever else a row carries is
left alone. All statistics come from distributed aggregates; the driver keeps a few numbers per
feature and the category lists that any encoder of this kind has to hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.guards import ensure_no_forbidden_features
from ..operators.quantiles import exact_medians, unpivot_values
from ..schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from ..scratch import local_rows, materialise

FEATURES_COLUMN = "features"
VECTOR_COLUMN = "__vector"


@dataclass
class FeatureStats:
    rows: int
    medians: dict[str, float]
    missing: dict[str, int]
    means: dict[str, float]
    deviations: dict[str, float]
    modes: dict[str, str]
    categories: dict[str, list[str]]


def feature_groups(features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Numeric and categorical features in configured order, whatever the order asked for."""
    ensure_no_forbidden_features(features)
    return [c for c in NUMERIC_FEATURES if c in features], [c for c in CATEGORICAL_FEATURES if c in features]


def pack_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Put already prepared feature columns into the struct the models read."""
    numeric, categorical = feature_groups(features)
    packed = [F.col(c).cast("double").alias(c) for c in numeric] + [F.col(c).cast("string").alias(c) for c in categorical]
    return df.withColumn(FEATURES_COLUMN, F.struct(*packed))


def category_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows per (feature, value) in one pass over all categorical features."""
    return unpivot_values(df, features, "string").groupBy("feature", "value").agg(F.count("*").alias("n"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """Most frequent value per feature, the smallest one on ties."""
    return counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def ordinal_codes(counts: DataFrame) -> DataFrame:
    """Zero-based code of every value in sorted order, per feature."""
    code = F.row_number().over(Window.partitionBy("feature").orderBy("value")) - 1
    return counts.select("feature", "value", code.alias("code"))


def imputed_moments(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Missing count, mean and population deviation of each median-imputed feature, as one row."""
    aggregates = [F.count("*").alias("rows")]
    for c, median in medians.items():
        filled = F.coalesce(F.col(c).cast("double"), F.lit(median))
        aggregates += [
            F.count_if(F.col(c).isNull()).alias(f"missing_{c}"),
            F.avg(filled).alias(f"mean_{c}"),
            F.stddev_pop(filled).alias(f"deviation_{c}"),
        ]
    return df.agg(*aggregates)


def fit_feature_stats(df: DataFrame, features: Sequence[str]) -> FeatureStats:
    numeric, categorical = feature_groups(features)
    medians = {c: m for c, m in exact_medians(df, numeric).items() if m is not None}
    moments = imputed_moments(df, medians).first()
    modes: dict[str, str] = {}
    categories: dict[str, list[str]] = {}
    if categorical:
        counts = materialise(category_counts(df, categorical))
        modes = {r["feature"]: r["mode"] for r in most_frequent(counts).collect()}  # one row per feature
        for r in ordinal_codes(counts).orderBy("feature", "code").collect():  # the category lists
            categories.setdefault(r["feature"], []).append(r["value"])
    return FeatureStats(
        rows=moments["rows"],
        medians=medians,
        missing={c: moments[f"missing_{c}"] for c in medians},
        means={c: moments[f"mean_{c}"] for c in medians},
        deviations={c: moments[f"deviation_{c}"] for c in medians},
        modes=modes,
        categories=categories,
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(value: float) -> str:
    return f"double('{value!r}')"


def _impute_sql(stats: FeatureStats, scale: bool) -> tuple[list[str], list[str]]:
    """SQL columns and their names: numbers, missing indicators, then imputed categories."""
    columns, names = [], []

    def scaled(expression: str, mean: float, deviation: float) -> str:
        return f"({expression} - {_number(mean)}) / {_number(deviation or 1.0)}" if scale else expression

    for c, median in stats.medians.items():
        filled = f"coalesce({FEATURES_COLUMN}.`{c}`, {_number(median)})"
        columns.append(f"{scaled(filled, stats.means[c], stats.deviations[c])} AS `__num_{c}`")
        names.append(f"__num_{c}")
    for c, missing in stats.missing.items():
        if missing:
            share = missing / stats.rows
            flag = f"CAST({FEATURES_COLUMN}.`{c}` IS NULL AS DOUBLE)"
            columns.append(f"{scaled(flag, share, (share * (1 - share)) ** 0.5)} AS `__gap_{c}`")
            names.append(f"__gap_{c}")
    for c, mode in stats.modes.items():
        columns.append(f"coalesce({FEATURES_COLUMN}.`{c}`, {_sql_text(mode)}) AS `__cat_{c}`")
    return columns, names


def _indexer(spark: SparkSession, stats: FeatureStats, categorical: Sequence[str]) -> StringIndexerModel:
    """Indexer of all categories in sorted order, fitted on the category lists instead of the rows.

    Lists of different length leave nulls at their end, which the indexer does not count.
    """
    lists = local_rows(
        spark, list(zip_longest(*[stats.categories[c] for c in categorical])),
        [f"__cat_{c}" for c in categorical], ["string"] * len(categorical),
    )
    return StringIndexer(
        inputCols=lists.columns, outputCols=[f"__index_{c}" for c in categorical],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    ).fit(lists)


def linear_encoder(sample: DataFrame, stats: FeatureStats) -> PipelineModel:
    """Scaled numbers and indicators, and one-hot categories (unknown = all zeros).

    ``sample`` only lends its schema and session: no stage reads its rows.
    """
    columns, names = _impute_sql(stats, scale=True)
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]
    categorical = [c for c in CATEGORICAL_FEATURES if c in stats.categories]
    hot = [f"__hot_{c}" for c in categorical]
    if categorical:
        stages.append(_indexer(sample.sparkSession, stats, categorical))
        indexed = PipelineModel(stages).transform(sample)
        encoder = OneHotEncoder(inputCols=[f"__index_{c}" for c in categorical], outputCols=hot, dropLast=True)
        stages.append(encoder.fit(indexed))  # sizes come from the index metadata
    stages.append(VectorAssembler(inputCols=[*names, *hot], outputCol=VECTOR_COLUMN))
    return PipelineModel(stages)


def tree_encoder(spark: SparkSession, stats: FeatureStats) -> PipelineModel:
    """Imputed numbers, indicators and ordinal codes; an unknown category is -1.

    Codes are plain numbers without nominal metadata, so trees split them as ordered values.
    """
    columns, names = _impute_sql(stats, scale=False)
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")]
    categorical = [c for c in CATEGORICAL_FEATURES if c in stats.categories]
    if categorical:
        codes = [
            f"CASE WHEN `__index_{c}` >= {len(stats.categories[c])} THEN -1D ELSE `__index_{c}` END AS `__code_{c}`"
            for c in categorical
        ]
        stages += [_indexer(spark, stats, categorical), SQLTransformer(statement=f"SELECT *, {', '.join(codes)} FROM __THIS__")]
    stages.append(VectorAssembler(inputCols=[*names, *[f"__code_{c}" for c in categorical]], outputCol=VECTOR_COLUMN))
    return PipelineModel(stages)
