"""Sources, cleaning and guards."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from creditloom.functions.clean import clean_double, clip, log_amount, parse_month, parse_percent, parse_term_months, year_month, year_quarter
from creditloom.operators.guards import invalid_requests, validate_requests
from creditloom.operators.prepare import normalize_rejected, prepare_loans, scoring_features
from creditloom.operators.target import construct_target, drop_unlabelled, target_summary, unknown_statuses
from creditloom.plans.calibrate import Calibrator
from creditloom.plans.evaluate import context_labels
from creditloom.plans.score import add_decision, score
from creditloom.schema import FEATURES, LOG_FEATURES, NUMERIC_FEATURES, SCORE_COLUMNS
from creditloom.scratch import scratch_root
from creditloom.sources.bundle import ModelBundle, bundle_errors
from creditloom.sources.dataset import write_scored
from creditloom.sources.loans import damaged_records, first_rows, read_loans, read_scoring_batch, sample_loans, select_loan_columns, source_fingerprint
from creditloom.sources.testtables import loans, table
from creditloom.streaming.scoring import answer_requests, read_requests, score_requests, write_scores

from .catalog import query
from .sql import CATEGORIES, LOANS, NUMBERS, PREPARED, RESOLVED

_RAW_TEXT = "id, loan_status, issue_d, term, int_rate, revol_util, grade"


@query(f"with {LOANS} select {_RAW_TEXT}, round(loan_amnt, 6) as loan_amnt from loans")
def read_loan_columns(spark, folder):
    """Column-pruned loan source."""
    wanted = select_loan_columns(loans(spark, folder), ["loan_amnt", "int_rate", "revol_util", "grade"])
    return wanted.select(*[c.strip() for c in _RAW_TEXT.split(",")], "loan_amnt")


_ALREADY_NUMBERS = [c for c in NUMERIC_FEATURES if c not in ("int_rate", "revol_util")]
_TEXTS = ["id", "loan_status", "issue_d", "term", *[c for c in FEATURES if c not in _ALREADY_NUMBERS]]


@query(f"with {LOANS} select {', '.join(_TEXTS)}, {', '.join(f'round({c}, 6) as {c}' for c in _ALREADY_NUMBERS)} from loans")
def csv_loans(spark, folder):
    """Loans of all columns written as a CSV folder and read back as text; numbers are compared as numbers."""
    raw = loans(spark, folder).select(*_TEXTS, *_ALREADY_NUMBERS)
    path = write_scored(raw, f"{_folder(spark)}/csv")
    back = read_loans(spark, path, FEATURES)
    return back.select(*_TEXTS, *[F.col(c).cast("double").alias(c) for c in _ALREADY_NUMBERS])


def _folder(spark) -> str:
    return f"{scratch_root(spark)}/check-{uuid.uuid4().hex}"


_DIGEST = "md5(concat_ws('#', id, '42'))"


@query(
    f"""with {PREPARED},
ranked as (select *, row_number() over (partition by issue_dt order by {_DIGEST}, id) as rn,
  count(*) over (partition by issue_dt) as m, count(*) over () as t from prepared)
select id, issue_dt from ranked where rn <= greatest(1, cast(ceil(2000::double * m / t) as bigint))"""
)
def sampled_loans(spark, folder):
    """Sample that keeps every issue month."""
    prepared = prepare_loans(loans(spark, folder))
    return sample_loans(prepared, 2000, month="issue_dt").select("id", "issue_dt")


@query(f"with {LOANS} select id, grade from loans order by id limit 500")
def first_loans(spark, folder):
    """First rows in id order (the requested prefix is the feature)."""
    return first_rows(loans(spark, folder), 500).select("id", "grade")


def _fingerprint_sql(name: str, columns: dict[str, str]) -> str:
    ordered = sorted(columns)
    layout = "".join(f"{len(c)}:{c}:{columns[c]};" for c in ordered)
    field = "coalesce(concat(length(cast({c} as varchar)), ':', cast({c} as varchar)), '-')"
    words = ", ".join(f"cast(sum(cast(cast('0x' || substr(h, {1 + 8 * i}, 8) as bigint) as hugeint)) as varchar) as word{i + 1}" for i in range(4))
    return f"""with h as (select md5(concat({', '.join(field.format(c=c) for c in ordered)})) as h from {name})
select md5('{layout}') as layout, count(*) as rows, {words} from h"""


_ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
_LINES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}


@query(_fingerprint_sql("orders", _ORDERS))
def table_fingerprint(spark, folder):
    """Order-insensitive content fingerprint of all columns."""
    return source_fingerprint(table(spark, folder, "orders"))


@query(_fingerprint_sql("lineitem", _LINES))
def line_fingerprint(spark, folder):
    return source_fingerprint(table(spark, folder, "lineitem"))


_RECORD = """concat(cast(o_orderkey as {text}), ',"', case when o_orderkey % 3 = 0 then 'a, ""b""' else 'c' end, '"',
  case when o_orderkey % 10 = 0 then '' else ',x' end, case when o_orderkey % 7 = 0 then ',y' else '' end)"""


@query(f"select {_RECORD.format(text='varchar')} as record from orders where (o_orderkey % 10 = 0) <> (o_orderkey % 7 = 0)")
def csv_damaged_records(spark, folder):
    """Records with a field too few or too many, out of a CSV folder with quotes and commas in its fields."""
    path = f"{_folder(spark)}/csv"
    records = table(spark, folder, "orders").select(F.expr(_RECORD.format(text="string")).alias("value"))
    part = F.spark_partition_id().alias("part")
    headed = records.withColumn("part", part).groupBy("part").agg(F.concat_ws("\n", F.lit("id,grade,sub_grade"), F.collect_list("value")).alias("value"))
    headed.select("value").write.text(path)
    return damaged_records(spark, path)


@query(
    f"""with {LOANS} select id, round(try_cast(replace(trim(int_rate), '%', '') as double), 6) as int_rate,
  round(try_cast(replace(trim(revol_util), '%', '') as double), 6) as revol_util from loans"""
)
def percent_text(spark, folder):
    df = loans(spark, folder)
    return df.select("id", *[parse_percent(F.col(c)).alias(c) for c in ("int_rate", "revol_util")])


@query(f"with {LOANS} select id, cast(regexp_extract(term, '(\\d+)', 1) as int) as term_months from loans")
def term_months(spark, folder):
    return loans(spark, folder).select("id", parse_term_months(F.col("term")).alias("term_months"))


@query(
    f"""with {LOANS}, d as (select id, cast(try_strptime(issue_d, '%b-%Y') as date) as issue_dt from loans)
select id, issue_dt, cast(year(issue_dt) as int) as issue_year,
  concat(cast(year(issue_dt) as varchar), 'Q', cast(quarter(issue_dt) as varchar)) as issue_quarter,
  strftime(issue_dt, '%Y-%m') as issue_month from d"""
)
def issue_periods(spark, folder):
    df = loans(spark, folder).select("id", parse_month(F.col("issue_d")).alias("issue_dt"))
    d = F.col("issue_dt")
    return df.select(
        "id", d, F.year(d).alias("issue_year"), year_quarter(d).alias("issue_quarter"), year_month(d).alias("issue_month")
    )


_MIXED = "concat(cast(o_orderkey % 1000 as {text}), case o_orderkey % 5 when 0 then '' when 1 then '.5' when 2 then 'd' when 3 then '  ' else 'e1' end)"


@query(f"select o_orderkey, round(try_cast(trim({_MIXED.format(text='varchar')}) as double), 6) as value from orders")
def numbers_from_text(spark, folder):
    """Text with numbers, suffixes that are no numbers, blanks and exponents."""
    text = F.expr(_MIXED.format(text="string"))
    return table(spark, folder, "orders").select("o_orderkey", clean_double(text).alias("value"))


@query(f"with {LOANS} select id, round(least(greatest(dti, 0), 100), 6) as dti from loans")
def clipped_dti(spark, folder):
    return loans(spark, folder).select("id", clip(F.col("dti"), 0.0, 100.0).alias("dti"))


@query(
    f"with {LOANS} select id, "
    + ", ".join(f"case when {c} is not null then round(ln(1 + greatest({c}, 0)), 6) end as {c}" for c in LOG_FEATURES)
    + " from loans"
)
def log_amounts(spark, folder):
    return loans(spark, folder).select("id", *[log_amount(F.col(c)).alias(c) for c in LOG_FEATURES])


_ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in NUMERIC_FEATURES)


@query(
    f"""with {PREPARED} select id, {CATEGORIES}, {_ROUNDED}, y, term_months, issue_dt, cast(year(issue_dt) as int) as issue_year,
  concat(cast(year(issue_dt) as varchar), 'Q', cast(quarter(issue_dt) as varchar)) as issue_quarter,
  strftime(issue_dt, '%Y-%m') as issue_month from prepared"""
)
def prepared_loans(spark, folder):
    """Target, term, issue period and all 25 features of every resolved loan."""
    return prepare_loans(loans(spark, folder)).select(
        "id", *FEATURES, F.col("default").alias("y"), "term_months", "issue_dt", "issue_year", "issue_quarter", "issue_month"
    )


@query(
    f"""with {LOANS}, f as (select id, {NUMBERS} from loans)
select f.id, {', '.join(f'round(f.{c}, 6) as {c}' for c in NUMERIC_FEATURES)}, round(l.loan_amnt, 6) as raw_loan_amnt, l.int_rate as raw_int_rate
from f join loans l on f.id = l.id"""
)
def scoring_time_features(spark, folder):
    """Prepared features next to raw columns that stay as submitted; no target is needed."""
    df = loans(spark, folder)
    packed = df.withColumn("features", scoring_features(df))
    return packed.select(
        "id", *[F.col(f"features.{c}").alias(c) for c in NUMERIC_FEATURES],
        F.col("loan_amnt").alias("raw_loan_amnt"), F.col("int_rate").alias("raw_int_rate"),
    )


@query(f"with {PREPARED} select id, y from prepared")
def default_target(spark, folder):
    return construct_target(loans(spark, folder), unknown="fail_fast").select("id", F.col("default").alias("y"))


@query(f"with {LOANS} select id, loan_status from loans where trim(coalesce(loan_status, '')) in ({RESOLVED})")
def resolved_loans(spark, folder):
    return construct_target(loans(spark, folder)).select("id", "loan_status")


@query(
    """select trim(o_orderpriority) as loan_status, count(*) as rows from orders
where trim(coalesce(o_orderpriority, '')) not in ('Current', '') group by 1"""
)
def unknown_status_values(spark, folder):
    """Order priorities read as statuses: none of them is in the domain."""
    return unknown_statuses(table(spark, folder, "orders").select(F.col("o_orderpriority").alias("loan_status")))


@query(
    f"""with {LOANS} select 'default' as target, count(*) filter (where trim(coalesce(loan_status, '')) in ({RESOLVED})) as included_rows,
  count(*) filter (where trim(coalesce(loan_status, '')) not in ({RESOLVED})) as excluded_rows, count(*) as total_rows from loans"""
)
def target_counts(spark, folder):
    return target_summary(loans(spark, folder)).select("target", "included_rows", "excluded_rows", "total_rows")


_REJECTED = {
    "Amount Requested": "round(o_totalprice, 2)", "Application Date": "cast(cast(o_orderdate as date) as {text})",
    "Loan Title": "o_orderpriority", "Risk_Score": "cast(o_custkey % 850 as double)",
    "Debt-To-Income Ratio": "case when o_orderkey % 29 = 0 then 'n/a' else concat(cast(o_orderkey % 200 as {text}), '.5%') end",
    "Zip Code": "concat(cast(o_custkey % 1000 as {text}), 'xx')", "State": "o_orderstatus",
    "Employment Length": "case when o_orderkey % 9 = 0 then null else '5 years' end",
}


@query(
    f"""select {', '.join(f"{_REJECTED[k].format(text='varchar')} as {n}" for k, n in (
        ("Amount Requested", "amount_requested"), ("Application Date", "application_date"), ("Loan Title", "loan_title"),
        ("Risk_Score", "risk_score"), ("Zip Code", "zip_code"), ("State", "state"), ("Employment Length", "employment_length")))},
  round(try_cast(replace({_REJECTED["Debt-To-Income Ratio"].format(text="varchar")}, '%', '') as double), 6) as dti from orders"""
)
def rejected_applications(spark, folder):
    raw = table(spark, folder, "orders").selectExpr(*[f"{e.format(text='string')} as `{n}`" for n, e in _REJECTED.items()])
    return normalize_rejected(raw)


_THRESHOLDS = {"low_max": 0.15, "medium_max": 0.4}
_DECISION = """round({p}, 6) as p_default, round(1 - {p}, 6) as p_non_default,
  case when {p} < 0.15::double then 'low' when {p} < 0.4::double then 'medium' else 'high' end as risk_band,
  'v1' as model_version, 'stub' as model_type, cast(null as varchar) as calibration_method"""


@query(f"with {LOANS} select id, {_DECISION.format(p='p_raw')} from loans")
def decisions(spark, folder):
    """Complement, band and labels; an unknown label is NULL."""
    df = loans(spark, folder).select("id", F.col("p_raw").alias("p_default"))
    return add_decision(df, {"model_version": "v1", "risk_band_thresholds": _THRESHOLDS}, "stub")


@query(f"with {LOANS} select id, round(least(greatest(p_raw * 3 - 0.5::double, 0), 1), 6) as p_default from loans")
def identity_calibration(spark, folder):
    """Clipping of raw scores to [0, 1]."""
    df = loans(spark, folder).select("id", (F.col("p_raw") * 3 - 0.5).alias("p_raw"))
    return Calibrator("identity").apply(df).select("id", "p_default")


def _stub_bundle() -> ModelBundle:
    """A bundle whose model is one SQL formula over prepared features."""
    formula = "SELECT *, features.dti / 200 + features.fico_range_low / 4000 + coalesce(features.mort_acc, 1) / 50 AS p_raw FROM __THIS__"
    fields = ["loan_amnt", "dti", "fico_range_low", "mort_acc", "grade"]
    return ModelBundle(
        SQLTransformer(statement=formula), Calibrator("identity"), fields, "stub",
        {"model_version": "v1", "risk_band_thresholds": _THRESHOLDS},
    )


_FORMULA = "least(greatest(least(greatest(dti, 0), 100) / 200 + fico_range_low / 4000 + coalesce(mort_acc, 1) / 50, 0), 1)"


@query(f"with {LOANS} select id, round(loan_amnt, 6) as loan_amnt, int_rate, round(p_raw, 6) as p_raw, 'kept' as features, {_DECISION.format(p=_FORMULA)} from loans")
def scored_loans(spark, folder):
    """Raw rows scored with a bundle; the submitted columns come back unchanged."""
    submitted = loans(spark, folder).withColumn("features", F.lit("kept"))
    scored = score(submitted, _stub_bundle())
    return scored.select("id", "loan_amnt", "int_rate", "p_raw", "features", *SCORE_COLUMNS)


@query(f"with {LOANS} select id, int_rate, {_DECISION.format(p=_FORMULA)} from loans")
def scored_csv(spark, folder):
    """CSV in, scored CSV out, read back."""
    root = _folder(spark)
    write_scored(loans(spark, folder).drop("loan_status", "issue_d", "term"), f"{root}/in")
    write_scored(score(read_scoring_batch(spark, f"{root}/in"), _stub_bundle()), f"{root}/out")
    back = read_scoring_batch(spark, f"{root}/out")
    numbers = {c: F.col(c).cast("double") for c in ("p_default", "p_non_default")}
    return back.withColumns(numbers).select("id", "int_rate", *SCORE_COLUMNS)


def _request_rules() -> str:
    positive = "case when loan_amnt <= 0 then 'loan_amnt: must be > 0' end"
    util = "case when revol_util is not null and try_cast(replace(trim(revol_util), '%', '') as double) is null then 'revol_util: not a number' end"
    income = "case when annual_inc < 0 then 'annual_inc: must be >= 0' end"
    job = "case when emp_length is null then 'emp_length: missing' end"
    return f"concat_ws('; ', {positive}, {income}, {util}, {job})"


@query(f"with {LOANS} select id, {_request_rules()} as violations from loans")
def request_violations(spark, folder):
    df = loans(spark, folder).select("id", *FEATURES)
    return validate_requests(df, ["id"]).select("id", F.array_join("violations", "; ").alias("violations"))


@query(f"with {LOANS} select id from loans where {_request_rules()} <> ''")
def rejected_requests(spark, folder):
    df = loans(spark, folder).select("id", *FEATURES)
    return invalid_requests(validate_requests(df, ["id"])).select("id")


@query(f"with {LOANS} select id, {_DECISION.format(p=_FORMULA)} from loans where {_request_rules()} = ''")
def streamed_scores(spark, folder):
    """Request files validated and scored as a stream, read back from the sink."""
    root = _folder(spark)
    requests = loans(spark, folder).select("id", *FEATURES)
    requests.write.parquet(f"{root}/in")
    stream = read_requests(spark, f"{root}/in", requests.schema, "parquet")
    scored = score_requests(stream, _stub_bundle()).select("id", *SCORE_COLUMNS)
    write_scores(scored, f"{root}/out", f"{root}/progress", available_now=True).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(f"""with {LOANS}, r as (select id, cast(id as bigint) as k, {_request_rules()} as broken from loans)
select case when k % 11 = 0 then null else id end as id, case when k % 11 = 0 then 'record: cannot be read'
  when k % 13 = 0 then 'debt: not a field of a request' else broken end as violations
from r where broken <> '' or k % 11 = 0 or k % 13 = 0""")
def streamed_rejections(spark, folder):
    """Refused requests of a stream of JSON files: broken rules, unknown fields and lines that are no JSON."""
    root = _folder(spark)
    requests = loans(spark, folder).select("id", *FEATURES)
    k = F.col("id").cast("bigint")
    plain, more = F.to_json(F.struct(*requests.columns)), F.to_json(F.struct(*requests.columns, F.lit(1).alias("debt")))
    line = F.when(k % 11 == 0, F.concat(F.lit("{broken "), F.col("id"))).when(k % 13 == 0, more).otherwise(plain)
    requests.select(line.alias("value")).write.text(f"{root}/in")
    stream = read_requests(spark, f"{root}/in", requests.schema)
    answer_requests(stream, _stub_bundle(), f"{root}/out", f"{root}/progress", available_now=True).awaitTermination()
    refused = spark.read.parquet(f"{root}/out/refused")
    return refused.select("id", F.array_join("violations", "; ").alias("violations"))


@query("select d.doc_id, l.quality from documents d join labels l on d.doc_id = l.doc_id where l.quality is not null")
def labelled_rows(spark, folder):
    """Rows without a label dropped before fitting."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    joined = table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left")
    return drop_unlabelled(joined, "quality")


_CONTEXT = "case o_orderkey % 4 when 0 then 'smoke_sample' when 1 then 'synthetic_test_fixture' when 2 then 'full_lendingclub_local' else 'other' end"


@query(
    f"""select o_orderkey, case {_CONTEXT} when 'full_lendingclub_local' then 'Full LendingClub local data'
  when 'smoke_sample' then 'Smoke-test sample' when 'synthetic_test_fixture' then 'Synthetic/test fixture' else 'Unlabeled artifact' end as artifact_label from orders"""
)
def data_context_labels(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.expr(_CONTEXT).alias("artifact_data_context"))
    return context_labels(df).select("o_orderkey", "artifact_label")


_DOCUMENT = """concat('{{"feature_columns":', case when o_orderkey % 3 = 0 then '[]' else '["dti"]' end,
  ',"calibrator":', case when o_orderkey % 5 = 0 then 'null' else '{{"method":"identity"}}' end,
  ',"required_input_schema":{{"schema_version":1}},"metadata":{{"bundle_schema_version":1,"model_version":"v', cast(o_orderkey as {text}),
  '","source_fingerprint":"f","split_manifest":{{"a":1}},"split_summary":[1],"target_definition":"t","forbidden_feature_columns":["x"],"package_versions":{{"p":"1"}}',
  case when o_orderkey % 7 = 0 then '' else ',"training_timestamp":"2020"' end, '}}}}')"""


@query(
    """select o_orderkey, concat_ws('; ', case when o_orderkey % 5 = 0 then concat('missing calibrator: ', cast(o_orderkey as varchar)) end,
  case when o_orderkey % 3 = 0 then concat('missing feature columns: ', cast(o_orderkey as varchar)) end,
  case when o_orderkey % 7 = 0 then concat('missing metadata field `training_timestamp`: ', cast(o_orderkey as varchar)) end) as errors from orders
where o_orderkey % 13 <> 0 union all select o_orderkey, concat('missing artifact: ', cast(o_orderkey as varchar)) from orders where o_orderkey % 13 = 0"""
)
def bundle_readiness(spark, folder):
    """What each bundle document of a store lacks; every thirteenth is absent."""
    documents = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 13 != 0, F.expr(_DOCUMENT.format(text="string"))).alias("document"),
    )
    return bundle_errors(documents).select("o_orderkey", F.array_join("errors", "; ").alias("errors"))
