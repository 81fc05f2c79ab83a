"""Training of the main bundle and of the compact bundle on its most important features."""

from __future__ import annotations

from datetime import datetime, timezone
import platform
from collections.abc import Sequence

import pyspark
from pyspark.sql import DataFrame, functions as F

from ..operators.compare import top_features
from ..operators.metrics import risk_thresholds
from ..operators.quantiles import exact_medians
from ..operators.target import drop_unlabelled
from ..schema import (
    BAD_STATUSES,
    COMPACT_FEATURE_COUNT,
    FEATURES,
    FORBIDDEN_FEATURES,
    GOOD_STATUSES,
    LIMITATIONS,
    LOG_FEATURES,
    MODEL_VERSION,
    NUMERIC_FEATURES,
    TARGET,
    UNRESOLVED_STATUSES,
)
from ..sources.bundle import ModelBundle, save_bundle
from ..sources.dataset import LoanDataset, prepare_dataset, write_report
from .evaluate import data_context, generate_reports, score_split
from .features import pack_features
from .importance import permutation_importance
from .models import predict_raw
from .select import Candidate, TrainingOptions, comparison_rows, select_candidate


def field_defaults(train: DataFrame, fields: Sequence[str]) -> dict[str, float]:
    """Training medians of numeric fields in raw units; logged fields are turned back."""
    numeric = [f for f in fields if f in NUMERIC_FEATURES]
    medians = exact_medians(train, numeric)
    logged = [f for f in numeric if f in LOG_FEATURES and medians[f] is not None]
    if logged:
        # Undone by Spark with the inverse of the function that Spark applied.
        row = train.sparkSession.range(1).select(*[F.expm1(F.lit(medians[f])).alias(f) for f in logged]).first()
        medians.update(row.asDict())
    return medians


def bundle_metadata(selected: Candidate, features: Sequence[str], dataset: LoanDataset, options: TrainingOptions, candidates: Sequence[Candidate], **extra) -> dict:
    m = selected.metrics
    counts = dataset.manifest["row_counts"]
    label = f"calibrated_{selected.model_name}"
    summaries = [
        {"model_name": c.model_name, "calibration_method": c.calibration_method, **c.cv} for c in candidates
    ]
    return {
        "bundle_schema_version": 1,
        "training_timestamp": datetime.now(timezone.utc).isoformat(),
        "rejected_applications": "renamed and cleaned for description only; without an outcome they never enter training",
        "model_version": MODEL_VERSION,
        "target_name": TARGET,
        "target_definition": "resolved accepted/funded loan default target",
        "good_statuses": sorted(GOOD_STATUSES),
        "bad_statuses": sorted(BAD_STATUSES),
        "dropped_statuses": sorted(UNRESOLVED_STATUSES),
        "target_summary": dataset.target_summary,
        "source_fingerprint": dataset.fingerprint,
        "split_manifest": dataset.manifest,
        "split_summary": dataset.split_rows,
        "split_date_boundaries": dataset.manifest["date_ranges"],
        "split_row_counts": counts,
        "split_default_rates": dataset.manifest["default_rates"],
        "selected_model_name": selected.model_name,
        "selected_model_type": label,
        "calibration_method": selected.calibration_method,
        "validation_metrics_summary": {
            "rows": m["rows"],
            "observed_default_rate": m["actual_default_rate"],
            "mean_predicted_default_rate": m["mean_predicted_default"],
            **{k: m[k] for k in ("roc_auc", "pr_auc", "brier_score", "log_loss")},
            "selected_model": selected.model_name,
            "calibration_method": selected.calibration_method,
        },
        "cross_validation_summary": {
            "enabled": options.cross_validation,
            "selected_model_name": selected.model_name,
            "selected_calibration_method": selected.calibration_method,
            "candidate_summaries": summaries,
        },
        "risk_band_thresholds": risk_thresholds(selected.scores),
        "feature_columns": list(features),
        "forbidden_feature_columns": sorted(FORBIDDEN_FEATURES),
        "limitations": list(LIMITATIONS),
        "package_versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
        **extra,
    }


def _bundle(selected: Candidate, features: Sequence[str], metadata: dict) -> ModelBundle:
    schema = {"schema_version": 1, "required_fields": list(features), "forbidden_fields": metadata["forbidden_feature_columns"]}
    return ModelBundle(
        selected.model, selected.calibrator, list(features), f"calibrated_{selected.model_name}", metadata, schema
    )


def train(source: DataFrame, output: str, options: TrainingOptions | None = None, sample: int | None = None, validation_only: bool = False, context: str | None = None, dataset_root: str | None = None) -> ModelBundle:
    """Train, select, calibrate and save; writes ``bundle``, ``compact_bundle`` and ``reports``.

    ``validation_only`` skips feature importance and the compact bundle.
    """
    options = options or TrainingOptions()
    label = data_context(sample, context)
    spark = source.sparkSession
    dataset = prepare_dataset(source, dataset_root or f"{output}/datasets", FEATURES, sample)
    features = [f for f in FEATURES if f in dataset.loans.columns]
    fitting, calibration, validation = (drop_unlabelled(dataset.split(s)) for s in ("train", "calibration", "validation"))
    selected, candidates = select_candidate(fitting, calibration, validation, features, options)
    write_report(comparison_rows(source, candidates), f"{output}/reports/validation/model_validation_results")
    extra = {"artifact_data_context": label, "sample_rows_requested": sample}

    importance: list[dict] = []
    fields: list[str] = []
    if not validation_only:
        packed = pack_features(validation, features)
        score = lambda df: selected.calibrator.apply(predict_raw(selected.model, df))
        changes = permutation_importance(packed, score, features)
        # One number per feature comes back.
        importance = [r.asDict() for r in top_features(changes, len(features)).collect()]
        fields = [r["feature"] for r in importance[:COMPACT_FEATURE_COUNT]]
        compact, others = select_candidate(fitting, calibration, validation, fields, options)
        details = bundle_metadata(
            compact, fields, dataset, options, others, **extra,
            frontend_fields=fields, frontend_defaults=field_defaults(fitting, fields), feature_importance=importance,
        )
        details["model_version"] = f"{MODEL_VERSION}-frontend"
        save_bundle(spark, _bundle(compact, fields, details), f"{output}/compact_bundle", dataset.test_ids())

    details = bundle_metadata(
        selected, features, dataset, options, candidates if not validation_only else [], **extra,
        frontend_fields=fields, frontend_defaults={}, feature_importance=importance,
    )
    bundle = _bundle(selected, features, details)
    save_bundle(spark, bundle, f"{output}/bundle", dataset.test_ids())
    generate_reports(bundle, score_split(bundle, validation), f"{output}/reports/validation", "validation")
    return bundle
