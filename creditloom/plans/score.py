"""Scoring of raw loan rows with a bundle; lazy, so batch and streaming share it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.clean import risk_band
from ..operators.guards import ensure_allowed_features, ensure_fields_present
from ..operators.prepare import scoring_features
from ..schema import DEFAULT_LOW_MAX, DEFAULT_MEDIUM_MAX, SCORE_COLUMNS
from ..sources.bundle import ModelBundle
from .features import FEATURES_COLUMN
from .models import predict_raw


_SUBMITTED = "__submitted"


def ensure_scorable(bundle: ModelBundle) -> None:
    ensure_allowed_features(bundle.feature_columns)
    if bundle.calibrator is None:
        raise ValueError("no calibrator in this bundle, so its scores cannot be calibrated")


def score(df: DataFrame, bundle: ModelBundle) -> DataFrame:
    """Submitted rows, unchanged, with the six score columns appended.

    Submitted columns travel in one struct, so none can meet a column of the model, whatever it is called. A
    submitted column with the name of a score column is an error.
    """
    ensure_scorable(bundle)
    ensure_fields_present(df, bundle.feature_columns)
    taken = [c for c in df.columns if c in SCORE_COLUMNS]
    if taken:
        raise ValueError(f"submitted columns carry names of score columns: {', '.join(taken)}")
    features = scoring_features(df, bundle.feature_columns).alias(FEATURES_COLUMN)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(_SUBMITTED), features)
    calibrated = bundle.calibrator.apply(predict_raw(bundle.model, packed))
    return add_decision(calibrated.select(f"{_SUBMITTED}.*", "p_default"), bundle.metadata, bundle.model_type)


def add_decision(df: DataFrame, metadata: dict, model_type: str | None = None) -> DataFrame:
    """Complement, risk band and model labels next to ``p_default``; unknown labels are NULL."""
    limits = metadata.get("risk_band_thresholds") or {}
    label = lambda v: F.lit(v).cast("string")
    return df.withColumns(
        {
            "p_non_default": 1 - F.col("p_default"),
            "risk_band": risk_band(
                F.col("p_default"), limits.get("low_max", DEFAULT_LOW_MAX), limits.get("medium_max", DEFAULT_MEDIUM_MAX)
            ),
            "model_version": label(metadata.get("model_version")),
            "model_type": label(metadata.get("selected_model_type", model_type)),
            "calibration_method": label(metadata.get("calibration_method")),
        }
    )
