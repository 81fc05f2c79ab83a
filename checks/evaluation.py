"""Split, metrics, curves, baselines, encoders and models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditloom.operators.bands import amount_bands, subgroup_reliability
from creditloom.operators.baselines import base_rate, comparison_metrics, group_rate_scores, group_rates, long_scores, rate_baseline_scores
from creditloom.operators.compare import attach_scores, comparison_table, id_set_difference, ids_only_in, select_best, top_features
from creditloom.operators.curves import pr_points, roc_points
from creditloom.operators.lift import risk_decile_lift
from creditloom.operators.metrics import calibration_bins, calibration_summary, mean_calibration_gap, metric_row, metric_rows, risk_thresholds, score_table
from creditloom.operators.ordered import ordered_table
from creditloom.operators.prepare import prepare_loans
from creditloom.operators.quantiles import exact_medians
from creditloom.operators.split import date_quality, fold_blocks, fold_sizes, in_splits, split_chronological, split_count_report, split_summary, test_ids
from creditloom.plans.calibrate import fit_calibrator
from creditloom.plans.features import (
    VECTOR_COLUMN,
    category_counts,
    fit_feature_stats,
    imputed_moments,
    linear_encoder,
    most_frequent,
    ordinal_codes,
    pack_features,
    tree_encoder,
)
from creditloom.plans.importance import permutation_importance
from creditloom.plans.models import fit_model, predict_raw
from creditloom.plans.select import FOLD_METRICS, TrainingOptions, comparison_rows, fold_means, select_candidate
from creditloom.plans.train import field_defaults
from creditloom.schema import CATEGORICAL_FEATURES, FEATURES, LOG_FEATURES, NUMERIC_FEATURES, TARGET
from creditloom.scratch import local_rows, materialise, scratch_root
from creditloom.sources.dataset import prepare_dataset
from creditloom.sources.testtables import loans, table

from .catalog import query
from .sql import PREPARED, SPLIT, bin_of, edge_list, metrics_select, newton_ctes, score_ctes

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def prepared(spark, folder):
    return prepare_loans(loans(spark, folder))


def split(spark, folder):
    return split_chronological(prepared(spark, folder))


def line_scores(spark, folder):
    """Scored order lines: the largest table, with tied scores ``p`` and almost unique scores ``q``."""
    return table(spark, folder, "lineitem").select(
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)").alias("id"),
        F.expr("round(l_discount * 5 + l_quantity / 100, 3)").alias("p"),
        F.expr("l_extendedprice / 120000").alias("q"),
        F.expr("case when l_returnflag = 'R' then 1 else 0 end").alias("y"),
        "l_linestatus",
    )


LINES = """lines as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as id,
  round(l_discount * 5 + l_quantity / 100, 3) as p, l_extendedprice / 120000 as q,
  case when l_returnflag = 'R' then 1 else 0 end as y, l_linestatus from lineitem)"""


# --- split ---------------------------------------------------------------------------------------


@query(f"with {SPLIT} select id, issue_dt, split from loans_split")
def chronological_split(spark, folder):
    return split(spark, folder).select("id", "issue_dt", "split")


_SUMMARY = """select split, count(*) as rows, round(avg(y), 6) as default_rate, min(issue_dt) as date_min, max(issue_dt) as date_max
from loans_split group by split"""


@query(f"with {SPLIT} {_SUMMARY}")
def split_overview(spark, folder):
    return split_summary(split(spark, folder))


@query(f"with {SPLIT} {_SUMMARY}")
def stored_dataset(spark, folder):
    """Prepared dataset written by split, read back and summarised."""
    dataset = prepare_dataset(loans(spark, folder).drop("p_raw"), f"{scratch_root(spark)}/datasets")
    return split_summary(dataset.loans)


@query(
    f"""with {PREPARED}, few as (select id, y, date_trunc('year', issue_dt)::date as d from prepared where year(issue_dt) < 1999),
counted as (select d, count(*) as n, avg(y) as r from few group by 1),
placed as (select *, coalesce(sum(n) over (order by d rows between unbounded preceding and 1 preceding), 0) as b, sum(n) over () as t from counted),
named as (select *, cast(b >= floor(t * 0.6::double) as int) + cast(b >= floor(t * 0.75::double) as int) + cast(b >= floor(t * 0.9::double) as int) as k from placed)
select s.split, coalesce(cast(sum(n) as bigint), 0) as rows, min(d) as date_min, max(d) as date_max
from (values (0, 'train'), (1, 'calibration'), (2, 'validation'), (3, 'test')) s(k, split) left join named using (k) group by s.split"""
)
def split_of_few_dates(spark, folder):
    """Four dates only: a split may stay empty and is still listed."""
    df = prepared(spark, folder).filter(F.col("issue_year") < 1999)
    years = split_chronological(df.withColumn("issue_dt", F.trunc("issue_dt", "year")))
    return split_summary(years).drop("default_rate")


@query(f"with {SPLIT} select id from loans_split where split = 'test'")
def saved_test_ids(spark, folder):
    return test_ids(split(spark, folder))


@query(
    f"""with {SPLIT} select split, cast(year(issue_dt) as int) as issue_year, count(y) as rows, cast(sum(y) as bigint) as defaults,
  count(y) - cast(sum(y) as bigint) as non_defaults from loans_split group by 1, 2"""
)
def split_year_counts(spark, folder):
    return split_count_report(split(spark, folder))


@query(f"with {PREPARED} select count(*) as rows, count(*) - count(issue_dt) as missing_dates, count(distinct issue_dt) as distinct_dates from prepared")
def split_date_quality(spark, folder):
    q = date_quality(prepared(spark, folder))
    return q.select(*[F.col(c).cast("bigint").alias(c) for c in q.columns])


@query(f"with {SPLIT} select id, split from loans_split where split in ('train', 'calibration')")
def fitting_rows(spark, folder):
    """Training and calibration rows together."""
    return in_splits(split(spark, folder), "train", "calibration").select("id", "split")


@query(
    f"""with {PREPARED}, k as (select *, row_number() over (order by issue_dt, id) - 1 as rn, count(*) over () as n from prepared),
f as (select *, least(4, greatest(2, n // 10)) as folds from k)
select id, cast(greatest(0, (rn - (n - folds * (n // (folds + 1)))) // (n // (folds + 1)) + 1) as int) as block
from (select * from f) where rn >= n - folds * (n // (folds + 1))
union all
select id, 0 as block from f where rn < n - folds * (n // (folds + 1))"""
)
def time_series_folds(spark, folder):
    """Test block of every row of the expanding folds."""
    blocked, _ = fold_blocks(prepared(spark, folder))
    return blocked.select("id", F.col("block").cast("int").alias("block"))


_FOLDS = f"""{PREPARED}, k as (select *, row_number() over (order by issue_dt, id) - 1 as rn, count(*) over () as n from prepared),
f as (select *, n // 5 as size from k),
b as (select *, case when rn < n - 4 * size then 0 else (rn - (n - 4 * size)) // size + 1 end as block from f)"""


@query(
    f"""with {_FOLDS}, numbers as (select unnest([1, 2, 3, 4]) as fold)
select cast(fold as int) as fold, count(*) filter (where block < fold) as train_rows, count(*) filter (where block = fold) as validation_rows
from numbers join b on block <= fold group by 1"""
)
def fold_row_counts(spark, folder):
    blocked, folds = fold_blocks(prepared(spark, folder))
    return fold_sizes(blocked, folds).select("fold", "train_rows", "validation_rows")


@query(
    f"""with {_FOLDS}, s as (select block, p_raw as p, y from b where block > 0), {score_ctes('select * from s', 'block')},
m as ({metrics_select('block')}), ed as (select block, {edge_list('p', 10)} as e from s group by 1),
bn as (select s.block, s.p, s.y, {bin_of('s.p', 'e')} as decile from s join ed on s.block = ed.block),
gaps as (select block, round(avg(gap), 6) as gap from (select block, decile, abs(avg(p) - avg(y)) as gap from bn group by 1, 2) group by 1)
select round(avg(roc_auc), 6) as mean_roc_auc, round(avg(pr_auc), 6) as mean_pr_auc, round(avg(brier_score), 6) as mean_brier_score,
  round(avg(log_loss), 6) as mean_log_loss, round(avg(mean_predicted_default), 6) as mean_predicted_default,
  round(avg(actual_default_rate), 6) as mean_actual_default_rate, round(avg(gap), 6) as mean_absolute_calibration_gap
from m join gaps on m.block = gaps.block"""
)
def fold_mean_metrics(spark, folder):
    """Fold metrics of a fixed score and their means."""
    blocked, _ = fold_blocks(prepared(spark, folder))
    scores = score_table(blocked.filter("block > 0"), "p_raw", by=["block"])
    # Rounded per fold as the fold report is.
    gaps = mean_calibration_gap(calibration_bins(scores, edge_digits=12), ["block"])
    folds = metric_rows(scores).join(gaps, "block").select(*[F.round(m, 6).alias(m) for m in FOLD_METRICS])
    return fold_means(folds)


# --- metrics -------------------------------------------------------------------------------------


@query(f"with {PREPARED}, {score_ctes('select p_raw as p, y from prepared')} {metrics_select()}")
def probability_metrics(spark, folder):
    return metric_rows(score_table(prepared(spark, folder), "p_raw"))


@query(f"with {LINES}, {score_ctes('select p, y from lines')} {metrics_select()}")
def line_metrics(spark, folder):
    """Metrics of many rows with tied scores."""
    return metric_rows(score_table(line_scores(spark, folder), "p", "y"))


@query(f"with {LINES}, {score_ctes('select q as p, y from lines')} {metrics_select()}")
def line_metrics_unique_scores(spark, folder):
    """Metrics of many rows with almost unique scores."""
    return metric_rows(score_table(line_scores(spark, folder), "q", "y"))


@query(
    f"""with {PREPARED}, s as (select home_ownership, p_raw as p, y from prepared), {score_ctes('select * from s', 'home_ownership')}
{metrics_select('home_ownership')}"""
)
def metrics_per_segment(spark, folder):
    return metric_rows(score_table(prepared(spark, folder), "p_raw", by=["home_ownership"]))


@query(
    f"""with {PREPARED}, s as (select cast(y as varchar) as y_class, case when id::bigint % 10 = 0 then null else p_raw end as p, y from prepared),
{score_ctes('select * from s', 'y_class')} {metrics_select('y_class')}"""
)
def single_class_metrics(spark, folder):
    """Groups with one class have no AUC or log loss; rows without a score are left out."""
    df = prepared(spark, folder).select(
        F.col("default").cast("string").alias("y_class"), "default",
        F.when(F.col("id").cast("bigint") % 10 != 0, F.col("p_raw")).alias("p_raw"),
    )
    return metric_rows(score_table(df, "p_raw", by=["y_class"]))


_BINNED = f"""edges as (select {edge_list('p_raw', 10)} as e from prepared),
binned as (select p_raw as p, y, {bin_of('p_raw', 'e')} as decile from prepared, edges)"""
_RELIABILITY = "count(*) as count, round(avg(p), 6) as mean_predicted_default, round(avg(y), 6) as observed_default_rate, round(abs(avg(p) - avg(y)), 6) as absolute_calibration_gap"


@query(f"with {PREPARED}, {_BINNED} select cast(decile as int) as decile, {_RELIABILITY} from binned group by decile")
def calibration_deciles(spark, folder):
    return calibration_bins(score_table(prepared(spark, folder), "p_raw"), edge_digits=12)


@query(
    f"""with {LINES}, edges as (select {edge_list('p', 7)} as e from lines), binned as (select p, y, {bin_of('p', 'e')} as decile from lines, edges)
select cast(decile as int) as decile, {_RELIABILITY} from binned group by decile"""
)
def line_calibration_bins(spark, folder):
    return calibration_bins(score_table(line_scores(spark, folder), "p", "y"), 7, edge_digits=12)


@query(
    f"""with {PREPARED}, {_BINNED}, b as (select decile, abs(avg(p) - avg(y)) as gap from binned group by decile)
select round(avg(gap), 6) as mean_absolute_calibration_gap from b"""
)
def mean_calibration_error(spark, folder):
    return mean_calibration_gap(calibration_bins(score_table(prepared(spark, folder), "p_raw"), edge_digits=12))


@query(
    f"""with {PREPARED}, {_BINNED}, {score_ctes('select p_raw as p, y from prepared')}, m as ({metrics_select()}),
d as (select decile, count(*) as n, avg(p) as mp from binned group by decile)
select m.*, (select cast(count(*) as int) from d) as bins, (select round(max(mp), 6) from d) as top_bin_mean from m"""
)
def full_calibration_summary(spark, folder):
    """All metrics with the bins as an array, in one row."""
    summary = calibration_summary(prepared(spark, folder), "p_raw", edge_digits=12)
    return summary.select(
        *[c for c in summary.columns if c != "deciles"],
        F.size("deciles").alias("bins"), F.element_at("deciles", -1)["mean_predicted_default"].alias("top_bin_mean"),
    )


@query(
    f"""with {PREPARED}, {score_ctes('select p_raw as p, y from prepared')}, m as ({metrics_select()})
select 'fixed' as model_name, 'final_model' as model_role, rows, actual_default_rate as observed_default_rate,
  mean_predicted_default as mean_predicted_default_rate, roc_auc, pr_auc, brier_score, log_loss from m"""
)
def model_metric_row(spark, folder):
    return metric_row(metric_rows(score_table(prepared(spark, folder), "p_raw")), "fixed", "final_model")


@query(
    f"""with {PREPARED}, edges as (select {edge_list('loan_amnt', 4)} as e from prepared),
s as (select *, cast({bin_of('loan_amnt', 'e')} as varchar) as band from prepared, edges),
u as (select 'term_months' as dimension, cast(term_months as varchar) as value, p_raw as p, y from s union all
  select 'grade', grade, p_raw, y from s union all select 'sub_grade', sub_grade, p_raw, y from s union all select 'loan_amnt_band', band, p_raw, y from s)
select dimension, value, count(*) as count, round(avg(p), 6) as mean_predicted_default, round(avg(y), 6) as observed_default_rate,
  round(avg(power(p - y, 2)), 6) as brier_score from u where value is not null group by 1, 2"""
)
def subgroup_calibration(spark, folder):
    return subgroup_reliability(prepared(spark, folder), "p_raw", edge_digits=12)


@query(
    f"""with edges as (select {edge_list('o_totalprice', 4, 6)} as e from orders), b as (select o_orderkey, {bin_of('o_totalprice', 'e')} as band, e from orders, edges)
select o_orderkey, cast(band as int) as band, round(e[band], 6) as band_lo, round(e[band + 1], 6) as band_hi from b"""
)
def price_bands(spark, folder):
    """Quartile band of every order with its limits."""
    bands = amount_bands(table(spark, folder, "orders"), "o_totalprice", edge_digits=6)
    return bands.select("o_orderkey", "band", "band_lo", "band_hi")


def _lift_sql(source: str) -> str:
    return f"""ranked as (select y, row_number() over (order by p desc, id) as r, count(*) over () as n from ({source}) where p is not null and y is not null),
bins as (select cast(ceil(r / n::double * 10) as int) as bin, count(*) as c, sum(y) as d from ranked group by 1),
b as (select k.bin, coalesce(c, 0) as c, coalesce(d, 0) as d from (select unnest(range(1, 11)) as bin) k left join bins using (bin)),
t as (select *, sum(c) over () as n, sum(d) over () as total, sum(d) over (order by bin) as captured, case when c > 0 then d / c else 0 end as rate from b)
select cast(bin as int) as predicted_risk_decile, cast(c as bigint) as count, round(rate::double, 6) as observed_default_rate,
  round(case when total > 0 then rate / (total / n) end, 6) as lift_versus_portfolio_default_rate,
  round(case when total > 0 then captured / total else 0 end::double, 6) as cumulative_share_of_defaults_captured from t"""


@query(f"with {PREPARED}, {_lift_sql('select id, p_raw as p, y from prepared')}")
def risk_lift(spark, folder):
    return risk_decile_lift(prepared(spark, folder), "p_raw")


@query(f"with {LINES}, {_lift_sql('select id, p, y from lines')}")
def line_risk_lift(spark, folder):
    """Lift over the largest table, where every bin limit falls inside a group of equal scores."""
    return risk_decile_lift(line_scores(spark, folder), "p", "y")


@query(f"with {PREPARED}, {_lift_sql('select id, p_raw as p, y from prepared where y = 0')}")
def lift_without_defaults(spark, folder):
    return risk_decile_lift(prepared(spark, folder).filter(F.col("default") == 0), "p_raw")


@query(
    f"""with {PREPARED} select 'low_max' as name, round(quantile_cont(p_raw, 1.0::double / 3), 6) as value from prepared
union all select 'medium_max', round(quantile_cont(p_raw, 2.0::double / 3), 6) from prepared"""
)
def tercile_thresholds(spark, folder):
    limits = risk_thresholds(score_table(prepared(spark, folder), "p_raw"))
    return local_rows(spark, list(limits.items()), ["name", "value"], ["string", "double"])


_ROC = """pts as (select *, lead(neg) over (order by p desc) as next_neg, lead(pos) over (order by p desc) as next_pos, row_number() over (order by p desc) as i from c),
kept as (select (flagged - caught)::double / (all_n - all_pos)::double as fpr, caught::double / all_pos::double as tpr, p as threshold from pts
  where i = 1 or next_neg is null or next_neg <> neg or next_pos <> pos)
select round(fpr, 6) as fpr, round(tpr, 6) as tpr, round(threshold, 6) as threshold from kept union all select 0.0::double, 0.0::double, 'Infinity'::double"""
_PR = """select round(caught::double / flagged::double, 6) as precision, round(caught::double / all_pos::double, 6) as recall, round(p, 6) as threshold from c
union all select 1.0::double, 0.0::double, null"""


@query(f"with {PREPARED}, {score_ctes('select p_raw as p, y from prepared')}, {_ROC}")
def roc_curve(spark, folder):
    return roc_points(score_table(prepared(spark, folder), "p_raw"))


@query(f"with {PREPARED}, {score_ctes('select p_raw as p, y from prepared')} {_PR}")
def precision_recall_curve(spark, folder):
    return pr_points(score_table(prepared(spark, folder), "p_raw"))


@query(f"with {LINES}, {score_ctes('select p, y from lines')}, {_ROC}")
def line_roc_curve(spark, folder):
    return roc_points(score_table(line_scores(spark, folder), "p", "y"))


@query(f"with {LINES} select id, row_number() over (order by p desc, id) as rank from lines")
def line_score_rank(spark, folder):
    """Distinct rank of every row, highest score first, ties by id."""
    rows = line_scores(spark, folder).select("id", (-F.col("p")).alias("k"), F.lit(1).alias("n"))
    return ordered_table(rows, ["k", "id"], ["n"]).running().select("id", (F.col("before_n") + 1).alias("rank"))


@query(f"with {PREPARED} select id, row_number() over (order by issue_dt, id) as place from prepared")
def date_order(spark, folder):
    """Place of every loan in (date, id) order."""
    rows = prepared(spark, folder).select("issue_dt", "id", F.lit(1).alias("n"))
    return ordered_table(rows, ["issue_dt", "id"], ["n"]).running().select("id", (F.col("before_n") + 1).alias("place"))


# --- joins, sets, candidates ---------------------------------------------------------------------


@query(f"with {PREPARED} select sub_grade, round(avg(y), 6) as rate from prepared group by 1")
def historical_rates(spark, folder):
    return group_rates(prepared(spark, folder), "sub_grade")


@query(
    f"""with {SPLIT}, r as (select sub_grade, avg(y) as rate from loans_split where split in ('train', 'calibration') and sub_grade <> 'E3' group by 1)
select l.id, round(coalesce(r.rate, 0.25::double), 6) as p_default from loans_split l left join r on l.sub_grade = r.sub_grade where l.split = 'test'"""
)
def historical_rate_scores(spark, folder):
    """Group rates looked up for test rows; a group unseen in fitting gets the fallback."""
    df = split(spark, folder)
    fit = in_splits(df, "train", "calibration").filter("sub_grade <> 'E3'")
    return group_rate_scores(fit, in_splits(df, "test"), "sub_grade", 0.25).select("id", "p_default")


@query(f"with {SPLIT} select round(avg(y), 6) as base_rate from loans_split where split = 'train'")
def base_default_rate(spark, folder):
    df = split(spark, folder)
    rate = base_rate(split_summary(df), in_splits(df, "train", "calibration"))
    return local_rows(spark, [(rate,)], ["base_rate"], ["double"])


def _baseline_sql() -> str:
    rates = "\n".join(
        f"r_{c} as (select {c}, avg(y) as rate from loans_split where split in ('train', 'calibration') group by 1)," for c in ("grade", "sub_grade")
    )
    return f"""{SPLIT}, {rates}
base as (select avg(y) as rate from loans_split where split = 'train'),
t as (select l.*, b.rate as p_base, coalesce(g.rate, b.rate) as p_grade, coalesce(s.rate, b.rate) as p_sub from loans_split l cross join base b
  left join r_grade g on l.grade = g.grade left join r_sub_grade s on l.sub_grade = s.sub_grade where l.split = 'test'),
long as (select 'fixed' as model_name, p_raw as p, y from t union all select 'base_rate', p_base, y from t
  union all select 'grade_historical_rate', p_grade, y from t union all select 'sub_grade_historical_rate', p_sub, y from t),
{score_ctes('select * from long', 'model_name')}, m as ({metrics_select('model_name')})
select model_name, case when model_name = 'fixed' then 'final_model' else 'baseline' end as model_role, rows, actual_default_rate as observed_default_rate,
  mean_predicted_default as mean_predicted_default_rate, roc_auc, pr_auc, brier_score, log_loss from m"""


@query(f"with {_baseline_sql()}")
def baseline_comparison(spark, folder):
    """A fixed score beside base rate and group rates on the test split, measured in one pass."""
    df = split(spark, folder)
    scored, names = rate_baseline_scores(df, ["grade", "sub_grade"], split_summary(df))
    columns = {"fixed": "p_raw", **names}
    roles = {m: "final_model" if m == "fixed" else "baseline" for m in columns}
    return comparison_metrics(long_scores(scored, columns), roles)


@query(f"with {PREPARED} select p.id, p.y, round(q.p_raw, 6) as p_score from prepared p join prepared q on p.id = q.id")
def aligned_scores(spark, folder):
    """Scores that come as a table, joined by id."""
    df = prepared(spark, folder)
    scores = df.select("id", F.col("p_raw").alias("p_score"))
    return attach_scores(df.select("id", F.col("default").alias("y")), scores)


_EXPECTED = "select c_custkey as id from customer"
_ACTUAL = "select o_custkey as id from orders where o_orderstatus <> 'P'"


@query(
    f"""with e as ({_EXPECTED}), a as ({_ACTUAL}) select (select count(*) from (select id from e except select id from a)) as missing,
  (select count(*) from (select id from a except select id from e)) as unexpected"""
)
def id_sets_compared(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    buyers = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("id"))
    return id_set_difference(customers, buyers)


@query(f"select cast(id as varchar) as id from ({_EXPECTED}) except select cast(id as varchar) from ({_ACTUAL})")
def missing_ids(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    buyers = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("id"))
    return ids_only_in(customers, buyers)


_CANDIDATES = f"""{PREPARED}, s as (select home_ownership as model_name, p_raw as p, y from prepared), {score_ctes('select * from s', 'model_name')},
m as ({metrics_select('model_name')}), ed as (select home_ownership as model_name, {edge_list('p_raw', 10)} as e from prepared group by 1),
bn as (select s.model_name, s.p, s.y, {bin_of('s.p', 'e')} as decile from s join ed on s.model_name = ed.model_name),
gaps as (select model_name, avg(gap) as gap from (select model_name, decile, abs(avg(p) - avg(y)) as gap from bn group by 1, 2) group by 1),
cand as (select m.*, round(gaps.gap, 6) as mean_absolute_calibration_gap from m join gaps on m.model_name = gaps.model_name)"""


def _candidates(spark, folder):
    """Segments as candidates, each with its metrics and mean gap."""
    scores = score_table(prepared(spark, folder).withColumnRenamed("home_ownership", "model_name"), "p_raw", by=["model_name"])
    gaps = mean_calibration_gap(calibration_bins(scores, edge_digits=12), ["model_name"])
    rows = metric_rows(scores).join(gaps, "model_name")
    numbers = [c for c in rows.columns if c not in ("model_name", "rows")]
    missing = {c: F.lit(None).cast("double") for c in ("cv_mean_absolute_calibration_gap", "cv_mean_brier_score")}
    return rows.select("model_name", "rows", *[F.round(c, 6).alias(c) for c in numbers]).withColumns(missing)


@query(
    f"""with {_CANDIDATES} select model_name, mean_absolute_calibration_gap, brier_score, log_loss from cand
order by mean_absolute_calibration_gap, brier_score, log_loss, -roc_auc, -pr_auc, model_name limit 1"""
)
def best_candidate(spark, folder):
    best = select_best(_candidates(spark, folder), SEGMENTS)
    return best.select("model_name", "mean_absolute_calibration_gap", "brier_score", "log_loss")


@query(f"with {_CANDIDATES} select model_name, mean_absolute_calibration_gap, brier_score, log_loss from cand where model_name = 'HOUSEHOLD'")
def pinned_candidate(spark, folder):
    """The best among the candidates of one pinned model."""
    best = select_best(_candidates(spark, folder), SEGMENTS, selected_model="HOUSEHOLD")
    return best.select("model_name", "mean_absolute_calibration_gap", "brier_score", "log_loss")


@query(
    f"""with {_CANDIDATES} select model_name, brier_score, log_loss, mean_absolute_calibration_gap from cand"""
)
def candidate_comparison(spark, folder):
    """All candidates in comparison order."""
    return comparison_table(_candidates(spark, folder)).select("model_name", "brier_score", "log_loss", "mean_absolute_calibration_gap")


# --- encoders and models -------------------------------------------------------------------------


@query(
    f"with {PREPARED} "
    + " union all ".join(f"select '{c}' as feature, round(quantile_cont({c}, 0.5::double), 6) as median from prepared" for c in NUMERIC_FEATURES)
)
def feature_medians(spark, folder):
    """Exact medians of all numeric features."""
    medians = exact_medians(materialise(prepared(spark, folder).select(*NUMERIC_FEATURES)), NUMERIC_FEATURES)
    return local_rows(spark, list(medians.items()), ["feature", "median"], ["string", "double"])


def _default_sql(field: str) -> str:
    median = f"quantile_cont({field}, 0.5::double)"
    return f"select '{field}' as field, round({f'exp({median}) - 1' if field in LOG_FEATURES else median}, 4) as value from t"


@query(f"with {SPLIT}, t as (select * from loans_split where split = 'train') " + " union all ".join(_default_sql(c) for c in NUMERIC_FEATURES))
def training_defaults(spark, folder):
    """Training medians in raw units of all features, categorical fields left out."""
    values = field_defaults(materialise(in_splits(split(spark, folder), "train").select(*FEATURES)), FEATURES)
    rows = [(k, round(v, 4)) for k, v in values.items()]
    return local_rows(spark, rows, ["field", "value"], ["string", "double"])


_IMPUTED = NUMERIC_FEATURES


@query(
    f"with {PREPARED}, m as (select {', '.join(f'quantile_cont({c}, 0.5::double) as m_{c}' for c in _IMPUTED)} from prepared) select count(*) as rows, "
    + ", ".join(
        f"count(*) - count({c}) as missing_{c}, round(avg(coalesce({c}, m_{c})), 6) as mean_{c}, round(stddev_pop(coalesce({c}, m_{c})), 6) as deviation_{c}"
        for c in _IMPUTED
    )
    + " from prepared, m"
)
def imputation_and_scaling(spark, folder):
    """Missing counts, means and deviations after exact median imputation."""
    df = materialise(prepared(spark, folder).select(*_IMPUTED))
    return imputed_moments(df, exact_medians(df, _IMPUTED))


_UNPIVOT = " union all ".join(f"select '{c}' as feature, {c} as value from prepared" for c in CATEGORICAL_FEATURES)
_COUNTED = f"u as ({_UNPIVOT}), k as (select feature, value, count(*) as n from u where value is not null group by 1, 2)"


@query(f"with {PREPARED}, {_COUNTED} select feature, value as mode from (select *, row_number() over (partition by feature order by n desc, value) as r from k) where r = 1")
def category_modes(spark, folder):
    return most_frequent(category_counts(prepared(spark, folder), CATEGORICAL_FEATURES))


@query(f"with {PREPARED}, {_COUNTED} select feature, value, cast(dense_rank() over (partition by feature order by value) - 1 as int) as code from k")
def category_codes(spark, folder):
    return ordinal_codes(category_counts(prepared(spark, folder), CATEGORICAL_FEATURES)).withColumn("code", F.col("code").cast("int"))


def _encoded_sql() -> str:
    medians = ", ".join(f"quantile_cont({c}, 0.5::double) as m_{c}" for c in NUMERIC_FEATURES)
    modes = ", ".join(f"max(case when feature = '{c}' then value end) as o_{c}" for c in CATEGORICAL_FEATURES)
    numbers = ", ".join(f"round(coalesce(p.{c}, m_{c}), 6) + 0.0::double as {c}" for c in NUMERIC_FEATURES)
    codes = ", ".join(
        f"(select count(*) from k where feature = '{c}' and value < coalesce(p.{c}, o_{c}))::int as {c}" for c in CATEGORICAL_FEATURES
    )
    return f"""{PREPARED}, {_COUNTED}, m as (select {medians} from prepared),
best as (select feature, value from (select *, row_number() over (partition by feature order by n desc, value) as r from k) where r = 1),
o as (select {modes} from best)
select p.id, {numbers}, {codes} from prepared p, m, o"""


@query(f"with {_encoded_sql()}")
def encoded_tree(spark, folder):
    """What the tree models read: imputed numbers and the ordinal codes of imputed categories."""
    packed = pack_features(prepared(spark, folder), FEATURES)
    stats = fit_feature_stats(prepared(spark, folder), FEATURES)
    columns = list(stats.medians)
    size = len(columns) + sum(1 for n in stats.missing.values() if n)
    codes = [c for c in CATEGORICAL_FEATURES if c in stats.categories]
    encoded = tree_encoder(spark, stats).transform(packed).select("id", vector_to_array(VECTOR_COLUMN).alias("v"))
    return encoded.select(
        "id", *[F.col("v")[i].alias(c) for i, c in enumerate(columns)],
        *[F.col("v")[size + i].cast("int").alias(c) for i, c in enumerate(codes)],
    )


@query(f"with {_encoded_sql()}")
def encoded_linear(spark, folder):
    """What the linear models read, turned back: scaled numbers times deviation plus mean, and the place of the one in each block."""
    packed = pack_features(prepared(spark, folder), FEATURES)
    stats = fit_feature_stats(prepared(spark, folder), FEATURES)
    encoded = linear_encoder(packed, stats).transform(packed).select("id", vector_to_array(VECTOR_COLUMN).alias("v"))
    numbers = [
        (F.col("v")[i] * F.lit(stats.deviations[c] or 1.0) + F.lit(stats.means[c])).alias(c) for i, c in enumerate(stats.medians)
    ]
    start, places = len(stats.medians) + sum(1 for n in stats.missing.values() if n), []
    for c in CATEGORICAL_FEATURES:
        size = len(stats.categories[c])
        places.append((F.array_position(F.slice("v", start + 1, size), 1.0) - 1).cast("int").alias(c))
        start += size
    return encoded.select("id", *numbers, *places)


_IMPORTANCE_FIELDS = list(FEATURES)
_IMPORTANCE_FORMULA = "least(greatest({d} / 200 + {f} / 4000 + case when {g} = 'A' then 0.1::double else 0 end, 0), 1)"


def _importance_sql() -> str:
    def loss(changed: str | None) -> str:
        pick = lambda c: f"d_{c}" if c == changed else c
        p = _IMPORTANCE_FORMULA.format(d=pick("dti"), f=pick("fico_range_low"), g=pick("grade"))
        return f"avg(power({p} - y, 2))"

    w = "over (order by md5(concat_ws('#', id, '42')), id)"
    donors = ", ".join(f"coalesce(lead({c}) {w}, first_value({c}) {w}) as d_{c}" for c in _IMPORTANCE_FIELDS)
    rows = " union all ".join(
        f"select '{c}' as feature, round({loss(c)} - {loss(None)}, 6) + 0.0::double as importance from t" for c in _IMPORTANCE_FIELDS
    )
    return f"{PREPARED}, t as (select id, y, {', '.join(_IMPORTANCE_FIELDS)}, {donors} from prepared) {rows}"


def _importance(spark, folder):
    df = pack_features(prepared(spark, folder), _IMPORTANCE_FIELDS)
    formula = F.expr(
        "least(greatest(features.dti / 200 + features.fico_range_low / 4000 + case when features.grade = 'A' then 0.1D else 0D end, 0D), 1D)"
    )
    return permutation_importance(df, lambda rows: rows.withColumn("p_default", formula), _IMPORTANCE_FIELDS)


@query(f"with {_importance_sql()}")
def feature_importance(spark, folder):
    """Permutation importance of a fixed scoring formula."""
    return _importance(spark, folder)


@query(f"with {_importance_sql()} order by abs(importance) desc, feature limit 2")
def most_important_features(spark, folder):
    """The two features with the largest change (the count is the feature)."""
    rounded = _importance(spark, folder).withColumn("importance", F.round("importance", 6))
    return top_features(rounded, 2)


@query(
    f"""with {PREPARED}, g as (select p_raw as p, count(*) as n, sum(y) as pos from prepared group by 1),
r as (select *, row_number() over (order by p) as i, sum(n) over (order by p) as cn, sum(pos) over (order by p) as cp from g),
a as (select j.i as j, k.i as k, (k.cp - j.cp + j.pos)::double / (k.cn - j.cn + j.n)::double as m from r j join r k on j.i <= k.i),
low as (select j, k as i, min(m) over (partition by j order by k desc rows unbounded preceding) as m from a),
fit as (select i, max(m) as m from low group by i)
select round(r.p, 6) as p_raw, round(fit.m, 6) as p_default from fit join r on fit.i = r.i"""
)
def isotonic_calibration(spark, folder):
    """Isotonic fit at every distinct score (its max-min form in SQL)."""
    scores = score_table(prepared(spark, folder), "p_raw")
    fitted = fit_calibrator(scores, "isotonic")
    return fitted.apply(scores.table.select(F.col("p").alias("p_raw"))).select("p_raw", "p_default")


@query(
    f"""with {PREPARED}, rows_fit as (select y, count(*) as w, [p_raw, 1.0::double] as x from prepared group by y, p_raw), {newton_ctes()}
select round(p_raw, 6) as p_raw, round(1 / (1 + exp(-(b[1] * p_raw + b[2]))), 6) as p_default from (select distinct p_raw from prepared), fitted"""
)
def sigmoid_calibration(spark, folder):
    """Sigmoid fit at every distinct score."""
    scores = score_table(prepared(spark, folder), "p_raw")
    return fit_calibrator(scores, "sigmoid").apply(scores.table.select(F.col("p").alias("p_raw"))).select("p_raw", "p_default")


def _fitted_metrics(spark, folder, name, **settings):
    df = materialise(split(spark, folder).select(*FEATURES, TARGET, "split"))  # fitting reads the rows many times
    model = fit_model(in_splits(df, "train"), FEATURES, name, **settings)
    return metric_rows(score_table(predict_raw(model, in_splits(df, "validation"), FEATURES), "p_raw"))


def logistic_ctes(weight: str, fit: tuple[str, ...], score: str) -> str:
    """CTE ``s_logistic`` (p, y): encoding and Newton steps on the rows of some splits, and the scores of another split's rows."""
    medians = ", ".join(f"quantile_cont({c}, 0.5::double) as m_{c}" for c in NUMERIC_FEATURES)
    moments = ", ".join(
        f"avg(coalesce({c}, m_{c})) as a_{c}, stddev_pop(coalesce({c}, m_{c})) as d_{c}, avg(case when {c} is null then 1.0::double else 0.0::double end) as g_{c}"
        for c in NUMERIC_FEATURES
    )
    scaled = [f"(coalesce({c}, m_{c}) - a_{c}) / case when d_{c} = 0 then 1 else d_{c} end" for c in NUMERIC_FEATURES]
    gaps = [f"case when g_{c} > 0 and g_{c} < 1 then (({c} is null)::int - g_{c}) / sqrt(g_{c} * (1 - g_{c})) else 0 end" for c in NUMERIC_FEATURES]
    modes = ", ".join(f"max(case when feature = '{c}' then value end) as o_{c}" for c in CATEGORICAL_FEATURES)
    lists = ", ".join(f"list(distinct {c}) filter ({c} is not null) as v_{c}" for c in CATEGORICAL_FEATURES)
    hot = " || ".join(f"list_transform(v_{c}, lambda v: case when v = coalesce({c}, o_{c}) then 1.0::double else 0.0::double end)" for c in CATEGORICAL_FEATURES)
    unpivoted = " union all ".join(f"select '{c}' as feature, {c} as value from t_fit" for c in CATEGORICAL_FEATURES)
    return f"""t_fit as (select * from loans_split where split in ({", ".join(f"'{x}'" for x in fit)})), med as (select {medians} from t_fit), mom as (select {moments} from t_fit, med),
values_fit as (select feature, value, count(*) as n from ({unpivoted}) where value is not null group by 1, 2),
best_fit as (select feature, value from (select *, row_number() over (partition by feature order by n desc, value) as r from values_fit) where r = 1),
modes_fit as (select {modes} from best_fit), lists_fit as (select {lists} from t_fit),
enc as materialized (select split, y, [{", ".join(scaled + gaps)}]::double[] || {hot} || [1.0::double] as x
  from loans_split, med, mom, modes_fit, lists_fit where split in ({", ".join(f"'{x}'" for x in (*fit, score))})),
rows_fit as (select y, {weight} as w, x from enc where split <> '{score}'), {newton_ctes()},
s_logistic as (select 1 / (1 + exp(-list_dot_product(x, b))) as p, y from enc, fitted where split = '{score}')"""


def _logistic_sql(weight: str) -> str:
    """Metrics of the validation rows of a model fitted on the training rows."""
    return f"with {SPLIT}, {logistic_ctes(weight, ('train',), 'validation')}, {score_ctes('select p, y from s_logistic')} {metrics_select()}"


@query(_logistic_sql("1.0::double"))
def logistic_model(spark, folder):
    """Validation metrics of the logistic model."""
    return _fitted_metrics(spark, folder, "logistic")


@query(_logistic_sql("count(*) over () / (2.0::double * count(*) over (partition by y))"))
def balanced_logistic_model(spark, folder):
    return _fitted_metrics(spark, folder, "logistic_balanced")


@query()
def forest_model(spark, folder):
    return _fitted_metrics(spark, folder, "random_forest")


@query()
def boosted_trees_model(spark, folder):
    return _fitted_metrics(spark, folder, "hist_gradient_boosting")


@query()
def candidate_grid(spark, folder):
    """All models with all features and calibrations, with cross-validation, at default settings."""
    df = materialise(split(spark, folder).select("id", "issue_dt", *FEATURES, TARGET, "split"))
    _, candidates = select_candidate(*[in_splits(df, s) for s in ("train", "calibration", "validation")], FEATURES, TrainingOptions())
    return comparison_rows(df, candidates)
