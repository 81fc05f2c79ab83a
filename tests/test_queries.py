"""Registered queries against the same queries in SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")

# One or two of each family; all of them run in the driver's own comparison.
CHOSEN = (
    "csv_loans", "sampled_loans", "table_fingerprint", "prepared_loans", "request_violations", "scored_csv", "streamed_scores",
    "stored_dataset", "split_of_few_dates", "time_series_folds", "metrics_per_segment", "line_metrics_unique_scores",
    "calibration_deciles", "subgroup_calibration", "line_risk_lift", "line_roc_curve", "baseline_comparison",
    "id_sets_compared", "best_candidate", "feature_medians", "category_codes", "feature_importance", "isotonic_calibration",
)


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return connection


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, tables, name):
    df = contract.queries()[name](spark, FOLDER)
    result = tables.execute(contract.oracle_sql()[name])
    expected, columns = result.fetchall(), [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(expected, columns)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert [r["rows"] for r in contract.entry(spark).collect()] != []
