"""Candidate grid: cross-validation, fit, calibration, and the choice of the best."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

from ..operators.compare import select_best
from ..operators.guards import ensure_no_forbidden_features
from ..operators.metrics import METRIC_COLUMNS, merge_scores, score_table, summary_of
from ..operators.ordered import OrderedTable
from ..operators.split import fold_blocks, fold_sizes
from ..schema import CALIBRATION_METHODS, MODEL_ALIASES, MODEL_NAMES, TARGET
from ..scratch import local_rows, materialise
from .calibrate import Calibrator, fit_calibrator
from .features import fit_feature_stats
from .models import RAW_SCORE, encoded_rows, encoder_of, fit_encoded, packed_rows, predict_encoded

# Fixed columns of the comparison report.
COMPARISON_COLUMNS = {
    "model_name": "string", "calibration_method": "string",
    "roc_auc": "double", "pr_auc": "double", "brier_score": "double", "log_loss": "double",
    "mean_predicted_default_rate": "double", "observed_default_rate": "double",
    "cv_mean_brier_score": "double", "cv_mean_log_loss": "double",
    "cv_mean_absolute_calibration_gap": "double", "cv_fold_count": "int",
}
FOLD_METRICS = ("roc_auc", "pr_auc", "brier_score", "log_loss", "mean_predicted_default", "actual_default_rate", "mean_absolute_calibration_gap")


@dataclass
class TrainingOptions:
    models: Sequence[str] = MODEL_NAMES
    calibration_methods: Sequence[str] = CALIBRATION_METHODS
    cross_validation: bool = True
    selected_model: str | None = None
    model_settings: dict[str, dict] = field(default_factory=dict)
    #: Fits that submit Spark jobs at the same time.
    parallelism: int = 8

    def __post_init__(self) -> None:
        """Resolve names and reject bad ones before any job starts."""
        self.models = [resolve_model_name(m) for m in self.models]
        unknown = [m for m in self.models if m not in MODEL_NAMES]
        if unknown:
            raise ValueError(f"unknown model candidates: {', '.join(unknown)}")
        if not self.models:
            raise ValueError("no enabled model candidates")
        unknown = [m for m in self.calibration_methods if m not in CALIBRATION_METHODS]
        if unknown:
            raise ValueError(f"unknown calibration methods: {', '.join(unknown)}")
        if not self.calibration_methods:
            raise ValueError("no enabled calibration methods")
        if self.selected_model is not None:
            self.selected_model = resolve_model_name(self.selected_model)
            if self.selected_model not in self.models:
                raise ValueError("selected_model must be one of the enabled model candidates")


def resolve_model_name(name: str) -> str:
    key = "_".join(name.strip().lower().replace("-", " ").split())
    return MODEL_ALIASES.get(key, key)


@dataclass
class Candidate:
    model_name: str
    calibration_method: str
    model: PipelineModel
    calibrator: Calibrator
    scores: OrderedTable
    metrics: dict
    cv: dict


def _summary(scores: OrderedTable) -> dict:
    """Metrics of one score table with its bins (ten at most) as plain values."""
    summary = summary_of(scores).first().asDict(recursive=True)
    gaps = [d["absolute_calibration_gap"] for d in summary["deciles"]]
    summary["mean_absolute_calibration_gap"] = sum(gaps) / len(gaps)
    return summary


def together(tasks: Sequence[Callable[[], object]], spark: SparkSession, at_once: int) -> list:
    """Results of ``tasks``, up to ``at_once`` of them submitting their Spark jobs at the same time from threads of their own."""
    run = inheritable_thread_target(spark)(lambda task: task())
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(run, tasks))


@dataclass
class _Fold:
    number: int
    train_rows: int
    validation_rows: int
    encoded: DataFrame


def _folds(train: DataFrame, features: Sequence[str], options: TrainingOptions) -> list[_Fold]:
    """Expanding time-series folds with both classes on either side; each fold is encoded once, with its own statistics, for all models."""
    spark = train.sparkSession
    numbered, folds = fold_blocks(train)
    if not folds:
        return []
    blocked = materialise(numbered.select(*features, TARGET, "block"))
    sizes = sorted(fold_sizes(blocked, folds).collect(), key=lambda r: r["fold"])  # one row for each fold
    usable = [s for s in sizes if s["train_classes"] == 2 and s["validation_classes"] == 2]

    def encoded(size) -> _Fold:
        stats = fit_feature_stats(blocked.filter(F.col("block") < size["fold"]), features)
        seen = blocked.filter(F.col("block") <= size["fold"])
        return _Fold(size["fold"], size["train_rows"], size["validation_rows"], encoded_rows(seen, features, stats, options.models, ["block"]))

    return together([partial(encoded, size) for size in usable], spark, options.parallelism)


def _scored(classifier: Transformer, encoded: DataFrame, name: str) -> OrderedTable:
    """Score table of a model on encoded rows. Scores are written first: Spark would work out each one again for the filter on it."""
    return score_table(materialise(predict_encoded(classifier, encoded, name)), RAW_SCORE)


def _fold_metrics(fold: _Fold, name: str, options: TrainingOptions) -> dict:
    past, ahead = fold.encoded.filter(F.col("block") < fold.number), fold.encoded.filter(F.col("block") == fold.number)
    classifier = fit_encoded(past, name, **options.model_settings.get(name, {}))
    summary = _summary(_scored(classifier, ahead, name))
    return {"fold": fold.number, "train_rows": fold.train_rows, "validation_rows": fold.validation_rows, **{m: summary[m] for m in FOLD_METRICS}}


def cross_validate(train: DataFrame, features: Sequence[str], options: TrainingOptions) -> dict[str, dict]:
    """Metrics of expanding time-series folds for every model; all fits of all folds may run at the same time."""
    folds = _folds(train, features, options)
    fits = [(name, fold) for name in _longest_first(options.models) for fold in reversed(folds)]
    found = together([partial(_fold_metrics, fold, name, options) for name, fold in fits], train.sparkSession, options.parallelism)
    return _cv_summaries(train, options, fits, found)


def _longest_first(models: Sequence[str]) -> list[str]:
    """Models in the order of their usual running time, so that none of the long ones is left alone at the end."""
    return sorted(models, key=lambda m: MODEL_NAMES.index(m), reverse=True)


def _cv_summaries(df: DataFrame, options: TrainingOptions, fits: Sequence[tuple[str, _Fold]], found: Sequence[dict]) -> dict[str, dict]:
    rows = {m: sorted((r for (name, _), r in zip(fits, found) if name == m), key=lambda r: r["fold"]) for m in options.models}
    return {name: {"fold_count": len(of), "folds": of, **_fold_means(df, of)} for name, of in rows.items()}


def fold_means(folds: DataFrame) -> DataFrame:
    """Mean of every fold metric; folds without a value are left out, and no value at all gives NULL."""
    return folds.agg(*[F.avg(m).alias(_mean_name(m)) for m in FOLD_METRICS])


def _mean_name(metric: str) -> str:
    fixed = {"mean_predicted_default": metric, "mean_absolute_calibration_gap": metric, "actual_default_rate": "mean_actual_default_rate"}
    return fixed.get(metric, f"mean_{metric}")


def _fold_means(df: DataFrame, folds: list[dict]) -> dict:
    if not folds:
        return {}
    values = [tuple(f[m] for m in FOLD_METRICS) for f in folds]
    return fold_means(local_rows(df.sparkSession, values, FOLD_METRICS, ["double"] * len(FOLD_METRICS))).first().asDict()


def select_candidate(train: DataFrame, calibration: DataFrame, validation: DataFrame, features: Sequence[str], options: TrainingOptions | None = None) -> tuple[Candidate, list[Candidate]]:
    """Fit each model once, calibrate it each way, and pick the best on validation.

    Rows of the splits and folds are encoded once each. The fits of all models and folds do not depend on each other and
    run at the same time, ``parallelism`` of them. The raw scores of a model are reduced to two score tables; every
    calibrator and every metric is computed from those.
    """
    options = options or TrainingOptions()
    ensure_no_forbidden_features(features)
    spark = train.sparkSession
    folds = _folds(train, features, options) if options.cross_validation else []
    stats = fit_feature_stats(train, features)
    splits = together([partial(encoded_rows, df, features, stats, options.models) for df in (train, calibration, validation)], spark, options.parallelism)

    def fitted(name: str) -> tuple[Transformer, OrderedTable, OrderedTable]:
        classifier = fit_encoded(splits[0], name, **options.model_settings.get(name, {}))
        return (classifier, *[_scored(classifier, encoded, name) for encoded in splits[1:]])

    names = _longest_first(options.models)
    fits = [(name, fold) for name in names for fold in reversed(folds)]
    # Those of one model stand together, its largest fit first.
    tasks = [task for name in names for task in (partial(fitted, name), *[partial(_fold_metrics, fold, n, options) for n, fold in fits if n == name])]
    results = together(tasks, spark, options.parallelism)
    each = 1 + len(folds)
    models = dict(zip(names, results[::each]))
    cv = _cv_summaries(train, options, fits, [r for i, r in enumerate(results) if i % each]) if options.cross_validation else {}

    def calibrated(name: str, method: str) -> Candidate:
        classifier, fitting, checking = models[name]
        calibrator = fit_calibrator(fitting, method)
        mapped = calibrator.apply(checking.table.select(F.col("p").alias(RAW_SCORE), "n", "pos"), "p")
        scores = merge_scores(mapped)
        encoder = encoder_of(spark, name, stats, packed_rows(train, features))
        return Candidate(name, method, PipelineModel([*encoder.stages, classifier]), calibrator, scores, _summary(scores), cv.get(name, {}))

    candidates = together([partial(calibrated, n, m) for n in options.models for m in options.calibration_methods], spark, options.parallelism)
    best = select_best(rank_rows(train, candidates), options.models, options.selected_model).first()
    chosen = (best["model_name"], best["calibration_method"])
    return next(c for c in candidates if (c.model_name, c.calibration_method) == chosen), candidates


def rank_rows(df: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    names = ["mean_absolute_calibration_gap", "brier_score", "log_loss", "roc_auc", "pr_auc"]
    values = [
        (
            c.model_name, c.calibration_method, *[c.metrics[n] for n in names],
            c.cv.get("mean_absolute_calibration_gap"), c.cv.get("mean_brier_score"),
        )
        for c in candidates
    ]
    columns = ["model_name", "calibration_method", *names, "cv_mean_absolute_calibration_gap", "cv_mean_brier_score"]
    return local_rows(df.sparkSession, values, columns, ["string", "string", *["double"] * 7])


def comparison_rows(df: DataFrame, candidates: Sequence[Candidate]) -> DataFrame:
    """Comparison report: one row per model and calibration method."""
    values = [
        (
            c.model_name, c.calibration_method, *[c.metrics[m] for m in METRIC_COLUMNS],
            c.cv.get("mean_brier_score"), c.cv.get("mean_log_loss"), c.cv.get("mean_absolute_calibration_gap"), c.cv.get("fold_count"),
        )
        for c in candidates
    ]
    return local_rows(df.sparkSession, values, list(COMPARISON_COLUMNS), list(COMPARISON_COLUMNS.values()))
