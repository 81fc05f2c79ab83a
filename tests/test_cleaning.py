from hashlib import md5
import datetime
import math

import pytest
from pyspark.sql import functions as F

from creditloom.functions.clean import clean_double, clip, log_amount, parse_month, parse_percent, parse_term_months, risk_band
from creditloom.operators.guards import (
    ensure_allowed_features,
    ensure_fields_present,
    ensure_no_forbidden_features,
    invalid_requests,
    valid_requests,
    validate_requests,
)
from creditloom.operators.prepare import clean_loans, normalize_rejected, prepare_loans, scoring_features
from creditloom.operators.target import construct_target, target_summary, unknown_statuses
from creditloom.schema import FEATURES, FORBIDDEN_FEATURES, TARGET

from fixtures import FEATURE_ROW, text_frame


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_numbers_from_text(spark):
    texts = ["12", " 1.5 ", "1e3", ".5", "-2", "12d", "0x1F", "abc", "", None, "NaN", "1_000", "\t7\n"]
    assert values(spark, texts, clean_double) == [12, 1.5, 1000, 0.5, -2, None, None, None, None, None, None, None, 7]


def test_nan_becomes_missing_in_numeric_columns(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    out = [r[0] for r in df.select(clean_double(F.col("x"), df.schema["x"].dataType)).collect()]
    assert out == [1.0, None, None]


def test_percent_term_and_month(spark):
    assert values(spark, ["10%", " 31.5 %", "7", "n/a", None], parse_percent) == [10, 31.5, 7, None, None]
    assert values(spark, [" 36 months", "60", "none", None], parse_term_months) == [36, 60, None, None]
    assert values(spark, ["Jan-2018", "2018-01", "", None], parse_month) == [datetime.date(2018, 1, 1), None, None, None]


def test_clip_and_log_keep_missing_values(spark):
    df = spark.createDataFrame([(-5.0,), (50.0,), (150.0,), (None,)], "x double")
    rows = df.select(clip(F.col("x"), 0.0, 100.0), log_amount(F.col("x"))).collect()
    assert [r[0] for r in rows] == [0, 50, 100, None]
    assert rows[0][1] == 0 and rows[1][1] == pytest.approx(math.log1p(50)) and rows[3][1] is None


def test_target_keeps_resolved_loans(spark):
    statuses = ["Fully Paid", " Does not meet the credit policy. Status:Fully Paid ", "Charged Off", "Default",
                "Does not meet the credit policy. Status:Charged Off", "Current", "", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(statuses)], "id int, loan_status string")
    for mode in ("list", "fail_fast"):
        assert [r[TARGET] for r in construct_target(df, mode).orderBy("id").collect()] == [0, 0, 1, 1, 1]
    summary = target_summary(df).first()
    assert (summary["included_rows"], summary["excluded_rows"], summary["total_rows"]) == (5, 3, 8)
    assert summary["bad_statuses"] == sorted(summary["bad_statuses"])


def test_unknown_status_is_an_error(spark):
    df = spark.createDataFrame([("Mystery Status",), ("Fully Paid",), ("Another",)], "loan_status string")
    assert {r["loan_status"] for r in unknown_statuses(df).collect()} == {"Mystery Status", "Another"}
    with pytest.raises(ValueError, match=r"unknown loan_status values: \['Another', 'Mystery Status'\]"):
        construct_target(df)
    with pytest.raises(Exception, match="unknown loan_status value"):
        construct_target(df, "fail_fast").collect()
    with pytest.raises(ValueError, match="must include loan_status"):
        construct_target(df.withColumnRenamed("loan_status", "status"))


def test_prepared_row(spark):
    row = {"id": "1", "loan_status": "Fully Paid", "issue_d": "May-2018", "term": " 36 months", **FEATURE_ROW,
           "loan_amnt": "9999", "annual_inc": "120000", "dti": "150", "revol_bal": "5000", "total_acc": "24", "revol_util": "55%"}
    out = prepare_loans(text_frame(spark, [row])).first()
    for name in ("loan_amnt", "annual_inc", "revol_bal", "total_acc"):
        assert out[name] == pytest.approx(math.log1p(float(row[name])))
    assert (out["dti"], out["int_rate"], out["revol_util"]) == (100, 10, 55)
    assert (out["issue_year"], out["issue_quarter"], out["issue_month"], out["term_months"]) == (2018, "2018Q2", "2018-05", 36)
    undated = prepare_loans(text_frame(spark, [{**row, "issue_d": "bad"}])).first()
    assert undated["issue_dt"] is None and undated["issue_quarter"] is None
    assert TARGET not in clean_loans(text_frame(spark, [row])).columns


def test_cleaning_runs_no_python(spark):
    row = {"id": "1", "loan_status": "Fully Paid", "issue_d": "May-2018", "term": " 36 months", **FEATURE_ROW}
    df = prepare_loans(text_frame(spark, [row]), "fail_fast")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_scoring_features_apply_the_log_once_and_keep_raw(spark):
    df = text_frame(spark, [FEATURE_ROW])
    out = df.withColumn("features", scoring_features(df, ["loan_amnt", "int_rate", "grade"])).first()
    assert out["features"].asDict() == {"loan_amnt": pytest.approx(math.log1p(1000)), "int_rate": 10.0, "grade": "A"}
    assert (out["loan_amnt"], out["int_rate"]) == ("1000", "10%")


def test_rejected_applications_get_no_target(spark):
    df = spark.createDataFrame([("1000", "12.5%", "CA", "x")], "`Amount Requested` string, `Debt-To-Income Ratio` string, State string, other string")
    out = normalize_rejected(df)
    assert out.columns == ["amount_requested", "dti", "state", "other"] and out.first()["dti"] == 12.5


def test_feature_guards(spark):
    with pytest.raises(ValueError, match="forbidden model features: loan_status, recoveries"):
        ensure_no_forbidden_features(["dti", "recoveries", "loan_status"])
    with pytest.raises(ValueError, match="not among the features"):
        ensure_allowed_features(["dti", "zip_code"])
    with pytest.raises(ValueError, match="missing required scoring fields: grade"):
        ensure_fields_present(text_frame(spark, [{"dti": "1"}]), ["dti", "grade"])
    assert len(FORBIDDEN_FEATURES) == 27 and not set(FORBIDDEN_FEATURES) & set(FEATURES)


def test_request_rules(spark):
    rows = [
        FEATURE_ROW,
        {**FEATURE_ROW, "loan_amnt": "0", "fico_range_low": "299", "fico_range_high": "901", "dti": "-1"},
        {**FEATURE_ROW, "annual_inc": None, "grade": None, "mort_acc": None, "application_type": None},
        {**FEATURE_ROW, "mort_acc": "many", "open_acc": "-1"},
    ]
    checked = validate_requests(text_frame(spark, [{"id": str(i), **r} for i, r in enumerate(rows)]), ["id"])
    found = {r["id"]: set(r["violations"]) for r in checked.collect()}
    assert found["0"] == set()
    assert found["1"] == {"loan_amnt: must be > 0", "fico_range_low: must be >= 300", "fico_range_high: must be <= 900", "dti: must be >= 0"}
    assert found["2"] == {"annual_inc: missing", "grade: missing"}
    assert found["3"] == {"mort_acc: not a number", "open_acc: must be >= 0"}
    assert valid_requests(checked).count() == 1 and invalid_requests(checked).count() == 3
    with pytest.raises(ValueError, match="extra request fields: zip"):
        validate_requests(text_frame(spark, [{**FEATURE_ROW, "zip": "1"}]))


def test_risk_band_treats_missing_as_high(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.2,), (None,), (float("nan"),)], "p double")
    assert [r[0] for r in df.select(risk_band(F.col("p"), 0.1, 0.2)).collect()] == ["low", "medium", "high", "high", "high"]


def test_fingerprint_sums_whole_numbers_per_group(spark):
    from creditloom.sources.loans import source_fingerprint

    df = spark.range(1000, numPartitions=3).selectExpr("id", "cast(id % 7 as string) as t")
    digests = [md5(f"{len(str(i))}:{i}1:{i % 7}".encode()).hexdigest() for i in range(1000)]
    found = source_fingerprint(df)
    row = found.first()
    assert row["rows"] == 1000 and [row[f"word{k + 1}"] for k in range(4)] == [str(sum(int(d[8 * k : 8 * k + 8], 16) for d in digests)) for k in range(4)]
    # Only the sums of the groups are decimals, not the words of every row.
    assert "conv" in (plan := found._jdf.queryExecution().analyzed().toString()) and "as decimal(28,0)" not in plan.split("+- Aggregate")[-1]


def test_fingerprints_that_must_differ(spark):
    from creditloom.sources.loans import fingerprint_text, source_fingerprint

    first = spark.createDataFrame([("a#b", "c"), (None, "x")], "p string, q string")
    second = spark.createDataFrame([("a", "b#c"), ("\\N", "x")], "p string, q string")
    prints = {fingerprint_text(df) for df in (first, second, first.withColumnRenamed("p", "r"), first.unionByName(first), first.limit(0))}
    assert len(prints) == 5
    assert fingerprint_text(first) == fingerprint_text(first.orderBy("q"))
    # Sums beyond 64 bits: the type of a word leaves room for as many rows as a table can have.
    row = source_fingerprint(spark.range(3))
    assert all(f.dataType.simpleString() == "string" for f in row.schema if f.name.startswith("word"))
    wide = spark.range(10).selectExpr("cast(4294967295 as decimal(28,0)) * cast(9000000000 as decimal(10,0)) as w").agg({"w": "sum"})
    assert wide.first()[0] == 10 * 4294967295 * 9000000000 > 2**63


def test_damaged_csv_records(spark, tmp_path):
    from creditloom.sources.loans import damaged_records, read_loans

    (tmp_path / "loans.csv").write_text('id,grade,term\n1,"A, ""x""",36\n2,B\n3,C,36,60\n4,D,60\n')
    assert sorted(r["record"] for r in damaged_records(spark, str(tmp_path)).collect()) == ["2,B", "3,C,36,60"]
    with pytest.raises(Exception, match="damaged CSV record"):
        read_loans(spark, str(tmp_path), ["grade"]).collect()
    (tmp_path / "loans.csv").write_text('id,grade,term\n1,"A\nx",36\n2,B,60\n')
    with pytest.raises(Exception, match="damaged CSV record"):
        read_loans(spark, str(tmp_path), ["grade"]).collect()
    whole = read_loans(spark, str(tmp_path), ["grade"], multi_line=True)
    assert sorted(tuple(r) for r in whole.select("id", "grade").collect()) == [("1", "A\nx"), ("2", "B")]


def test_unicode_blanks_are_stripped(spark):
    from creditloom.functions.clean import strip

    df = spark.createDataFrame([(" Fully Paid 　",)], "s string")
    assert df.select(strip(F.col("s"))).first()[0] == "Fully Paid"


def test_many_unknown_statuses_are_not_all_named(spark):
    df = spark.range(5000).selectExpr("concat('status ', id) as loan_status")
    with pytest.raises(ValueError, match="and more"):
        construct_target(df)
    assert unknown_statuses(df).count() == 5000
