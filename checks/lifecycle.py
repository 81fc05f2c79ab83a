"""Saved bundles from end to end: locked evaluation, evaluation of a split, and what their report files say."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from creditloom.plans.calibrate import Calibrator
from creditloom.operators.metrics import metric_rows, score_table
from creditloom.plans.evaluate import evaluate_locked, evaluate_on_split, generate_reports, score_split
from creditloom.plans.select import Candidate, TrainingOptions, together
from creditloom.plans.train import bundle_metadata
from creditloom.schema import FEATURES, SPLITS
from creditloom.scratch import local_rows, materialise, scratch_root
from creditloom.sources.bundle import ModelBundle, bundle_fingerprint, load_bundle, read_json_row, save_bundle
from creditloom.sources.dataset import prepare_dataset
from creditloom.sources.testtables import loans

from .catalog import query
from .evaluation import _lift_sql, logistic_ctes
from .sql import SPLIT, bin_of, edge_list, metrics_select, score_ctes

_FORMULA = "least(greatest({f}dti / 200 + {f}fico_range_low / 4000 + case when {f}grade = 'A' then {tenth} else {zero} end, {zero}), {one})"
_FORMULA_SPARK = _FORMULA.format(f="features.", tenth="0.1D", zero="0D", one="1D")
_FORMULA_SQL = _FORMULA.format(f="l.", tenth="0.1::double", zero="0::double", one="1::double")
_METRICS = ("observed_default_rate", "mean_predicted_default_rate", "roc_auc", "pr_auc", "brier_score", "log_loss")


def _formula_bundle(**metadata) -> ModelBundle:
    """A bundle whose model is an expression, so that SQL can say what it scores."""
    model = SQLTransformer(statement=f"SELECT *, {_FORMULA_SPARK} AS p_raw FROM __THIS__")
    facts = {"selected_model_name": "formula", "model_version": "v1", "training_timestamp": "2020-01-01T00:00:00+00:00", "calibration_method": "identity", **metadata}
    return ModelBundle(model, Calibrator("identity"), list(FEATURES), "calibrated_formula", facts, {"schema_version": 1})


def _long(df: DataFrame, report: str, item, fields) -> DataFrame:
    """(report, item, field, value) rows of a report table."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).cast("double").alias("value")) for name in fields])
    return df.select(F.lit(report).alias("report"), item.cast("string").alias("item"), F.inline(pairs))


def _curve_item(threshold):
    """A threshold as text: millionths, so that both engines spell it alike."""
    return F.when(threshold.isNull(), "end").when(threshold == float("inf"), "start").otherwise(F.round(threshold * 1e6).cast("bigint").cast("string"))


def _reports(spark, root: str) -> DataFrame:
    """All report files of a folder, read back, in long form."""
    csv = lambda name: spark.read.option("header", True).csv(f"{root}/{name}")
    metrics = spark.read.json(f"{root}/metrics_summary")
    parts = [_long(metrics, "metrics_summary", F.col("stage"), ["rows", *_METRICS])]
    deciles, lift, roc, pr = (csv(n) for n in ("calibration_deciles", "risk_decile_lift", "roc_curve", "pr_curve"))
    parts.append(_long(deciles, "calibration_deciles", F.col("decile"), [c for c in deciles.columns if c != "decile"]))
    parts.append(_long(lift, "risk_decile_lift", F.col("predicted_risk_decile"), [c for c in lift.columns if c != "predicted_risk_decile"]))
    parts.append(_long(roc, "roc_curve", _curve_item(F.col("threshold").cast("double")), ["fpr", "tpr"]))
    parts.append(_long(pr, "pr_curve", _curve_item(F.col("threshold").cast("double")), ["precision", "recall"]))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _reports_sql(split: str) -> str:
    """CTE ``reports`` of the formula's scores on a split."""
    lift = _lift_sql("select id, p, y from scored")
    return f"""scored as materialized (select id, y, {_FORMULA_SQL} as p from loans_split l where split = '{split}'), {score_ctes('select p, y from scored')},
m as ({metrics_select()}), lift as (with {lift}),
edges as (select {edge_list('p', 10, None)} as e from scored), binned as (select p, y, {bin_of('p', 'e')} as decile from scored, edges),
deciles as (select decile, count(*) as n, avg(p) as mp, avg(y) as o from binned group by 1),
pts as (select *, lead(neg) over (order by p desc) as next_neg, lead(pos) over (order by p desc) as next_pos, row_number() over (order by p desc) as i from c),
kept as (select * from pts where i = 1 or next_neg is null or next_neg <> neg or next_pos <> pos),
reports as (
  select 'metrics_summary' as report, '{split}' as item, unnest(['rows', 'observed_default_rate', 'mean_predicted_default_rate', 'roc_auc', 'pr_auc', 'brier_score', 'log_loss']) as field,
    unnest([rows::double, actual_default_rate, mean_predicted_default, roc_auc, pr_auc, brier_score, log_loss]) as value from m
  union all select 'calibration_deciles', cast(decile as varchar), unnest(['count', 'mean_predicted_default', 'observed_default_rate', 'absolute_calibration_gap']),
    unnest([n::double, mp, o, abs(mp - o)]) from deciles
  union all select 'risk_decile_lift', cast(predicted_risk_decile as varchar),
    unnest(['count', 'observed_default_rate', 'lift_versus_portfolio_default_rate', 'cumulative_share_of_defaults_captured']),
    unnest([count::double, observed_default_rate, lift_versus_portfolio_default_rate, cumulative_share_of_defaults_captured]) from lift
  union all select 'roc_curve', cast(cast(round(p * 1000000) as bigint) as varchar), unnest(['fpr', 'tpr']),
    unnest([(flagged - caught)::double / (all_n - all_pos)::double, caught::double / all_pos::double]) from kept
  union all select 'roc_curve', 'start', unnest(['fpr', 'tpr']), unnest([0.0::double, 0.0::double])
  union all select 'pr_curve', cast(cast(round(p * 1000000) as bigint) as varchar), unnest(['precision', 'recall']),
    unnest([caught::double / flagged::double, caught::double / all_pos::double]) from c
  union all select 'pr_curve', 'end', unnest(['precision', 'recall']), unnest([1.0::double, 0.0::double])
)"""


_LONG = "report, item, field, round(value, 6) as value"


@query(f"with {SPLIT}, {_reports_sql('validation')} select {_LONG} from reports")
def split_report(spark, folder):
    """All report files of a bundle's evaluation on the validation split of the raw source."""
    root = f"{scratch_root(spark)}/check-{uuid.uuid4().hex}"
    evaluate_on_split(_formula_bundle(), materialise(loans(spark, folder).drop("p_raw")), root, "validation")
    return _reports(spark, f"{root}/validation")


_NUMBERS_OF_SPLITS = "unnest(['rows', 'default_rate']) as field, unnest([count(*)::double, avg(y)]) as value"


@query(
    f"""with {SPLIT}, {_reports_sql('validation')}, cut as (select quantile_cont(p, 1.0::double / 3) as low, quantile_cont(p, 2.0::double / 3) as medium from scored),
facts as (
  select 'split' as part, split as item, {_NUMBERS_OF_SPLITS} from loans_split group by split
  union all select 'target_summary', 'rows', unnest(['included_rows', 'excluded_rows', 'total_rows']),
    unnest([(select count(*) from loans_split)::double, count(*) - (select count(*) from loans_split)::double, count(*)::double]) from loans
  union all select 'validation_metrics_summary', 'validation', unnest(['rows', 'observed_default_rate', 'mean_predicted_default_rate', 'roc_auc', 'pr_auc', 'brier_score', 'log_loss']),
    unnest([rows::double, actual_default_rate, mean_predicted_default, roc_auc, pr_auc, brier_score, log_loss]) from m
  union all select 'risk_band_thresholds', 'tercile', unnest(['low_max', 'medium_max']), unnest([low, medium]) from cut
  union all select 'feature_columns', 'count', 'features', {len(FEATURES)}
) select part, item, field, round(value, 6) as value from facts"""
)
def bundle_metadata_facts(spark, folder):
    """What the metadata of a bundle says about its data, splits and validation, read back from the saved document."""
    root = f"{scratch_root(spark)}/check-{uuid.uuid4().hex}"
    dataset = prepare_dataset(materialise(loans(spark, folder).drop("p_raw")), f"{root}/datasets")
    bundle = _formula_bundle()
    scores = score_table(score_split(bundle, dataset.split("validation")))
    candidate = Candidate("formula", "identity", bundle.model, bundle.calibrator, scores, metric_rows(scores).first().asDict(), {})
    bundle.metadata = bundle_metadata(candidate, FEATURES, dataset, TrainingOptions(), [candidate])
    save_bundle(spark, bundle, f"{root}/bundle", dataset.test_ids())
    saved = load_bundle(spark, f"{root}/bundle").metadata
    rows = [("split", s, "rows", saved["split_row_counts"][s]) for s in SPLITS] + [("split", s, "default_rate", saved["split_default_rates"][s]) for s in SPLITS]
    rows += [("target_summary", "rows", f, saved["target_summary"][f]) for f in ("included_rows", "excluded_rows", "total_rows")]
    rows += [("validation_metrics_summary", "validation", f, saved["validation_metrics_summary"][f]) for f in ("rows", *_METRICS)]
    rows += [("risk_band_thresholds", "tercile", f, v) for f, v in saved["risk_band_thresholds"].items()]
    rows += [("feature_columns", "count", "features", len(saved["feature_columns"]))]
    return local_rows(spark, [(*r[:3], float(r[3])) for r in rows], ["part", "item", "field", "value"], ["string", "string", "string", "double"])


def _locked_sql() -> str:
    rates = "\n".join(f"r_{c} as (select {c}, avg(y) as rate from loans_split where split in ('train', 'calibration') group by 1)," for c in ("grade", "sub_grade"))
    return f"""{SPLIT}, {_reports_sql('test')}, {rates}
base as (select avg(y) as rate from loans_split where split = 'train'), {logistic_ctes("1.0::double", ("train", "calibration"), "test")},
rated as (select l.y, {_FORMULA_SQL} as p_formula, b.rate as p_base, coalesce(g.rate, b.rate) as p_grade, coalesce(s.rate, b.rate) as p_sub from loans_split l cross join base b
  left join r_grade g on l.grade = g.grade left join r_sub_grade s on l.sub_grade = s.sub_grade where l.split = 'test'),
long as (select 'formula' as model_name, p_formula as p, y from rated union all select 'base_rate', p_base, y from rated union all select 'logistic_regression', p, y from s_logistic
  union all select 'grade_historical_rate', p_grade, y from rated union all select 'sub_grade_historical_rate', p_sub, y from rated),
compared as (with {score_ctes('select * from long', 'model_name')} {metrics_select('model_name')}),
baselines as (
  select 'baseline_comparison' as report, model_name as item, unnest(['rows', 'observed_default_rate', 'mean_predicted_default_rate', 'roc_auc', 'pr_auc', 'brier_score', 'log_loss']) as field,
    unnest([rows::double, actual_default_rate, mean_predicted_default, roc_auc, pr_auc, brier_score, log_loss]) as value from compared
)
select {_LONG} from reports union all select {_LONG} from baselines
union all select 'evaluation_manifest', 'baseline_comparison', field, round(value, 6) from baselines where item = 'logistic_regression'
union all select 'evaluation_manifest', 'locked_test_metrics', field, round(value, 6) from reports where report = 'metrics_summary'
union all select 'evaluation_manifest', 'checks', unnest(['bundle_fingerprint', 'source_fingerprint', 'other_source_refused', 'other_report_refused', 'other_ids_refused']), 1.0::double"""


@query(f"with {_locked_sql()}")
def locked_evaluation(spark, folder):
    """A bundle saved, loaded, checked and evaluated on its locked test split: every report file and the manifest."""
    root = f"{scratch_root(spark)}/check-{uuid.uuid4().hex}"
    source = materialise(loans(spark, folder).drop("p_raw"))
    dataset = prepare_dataset(source, f"{root}/datasets")
    bundle = _formula_bundle(source_fingerprint=dataset.fingerprint)
    save_bundle(spark, bundle, f"{root}/bundle", dataset.test_ids())
    generate_reports(bundle, score_split(bundle, dataset.split("validation")), f"{root}/reports/validation", "validation")

    def refused(bundle_path: str, rows: DataFrame, reports: str) -> bool:
        try:
            evaluate_locked(spark, bundle_path, rows, reports, f"{root}/datasets")
        except ValueError:
            return True
        return False

    def other_ids() -> bool:
        save_bundle(spark, _formula_bundle(source_fingerprint=dataset.fingerprint), f"{root}/other", dataset.test_ids().limit(1))
        return refused(f"{root}/other", source, f"{root}/reports")

    def other_report() -> bool:
        save_bundle(spark, _formula_bundle(selected_model_name="other", source_fingerprint=dataset.fingerprint), f"{root}/renamed", dataset.test_ids())
        return refused(f"{root}/renamed", source, f"{root}/reports")

    # The evaluation and the refusals do not depend on each other; only the evaluation writes reports.
    _, *refusals = together([
        lambda: evaluate_locked(spark, f"{root}/bundle", source, f"{root}/reports", f"{root}/datasets"),
        lambda: refused(f"{root}/bundle", source.filter("id <> '1'"), f"{root}/reports"), other_report, other_ids,
    ], spark, 4)
    manifest = read_json_row(spark, f"{root}/reports/test/evaluation_manifest")
    checks = {
        "bundle_fingerprint": manifest["bundle_fingerprint"] == bundle_fingerprint(spark, f"{root}/bundle"),
        "source_fingerprint": manifest["source_fingerprint"] == dataset.fingerprint,
        **dict(zip(("other_source_refused", "other_report_refused", "other_ids_refused"), refusals)),
    }
    held = spark.read.json(f"{root}/reports/test/evaluation_manifest")
    fields = ["rows", *_METRICS]
    logistic = held.select(F.inline("baseline_comparison")).filter("model_name = 'logistic_regression'")
    table = spark.read.option("header", True).csv(f"{root}/reports/test/baseline_comparison_table")
    marks = held.select(*[F.lit(float(v)).alias(k) for k, v in checks.items()])
    return (
        _reports(spark, f"{root}/reports/test")
        .unionByName(_long(table, "baseline_comparison", F.col("model_name"), fields))
        .unionByName(_long(logistic, "evaluation_manifest", F.lit("baseline_comparison"), fields))
        .unionByName(_long(held.select("locked_test_metrics.*"), "evaluation_manifest", F.lit("locked_test_metrics"), fields))
        .unionByName(_long(marks, "evaluation_manifest", F.lit("checks"), list(checks)))
    )

