import datetime
import random

import pytest
from pyspark.sql import functions as F

from creditloom.operators.prepare import prepare_loans
from creditloom.operators.split import fold_blocks, fold_count, fold_sizes, split_chronological, split_count_report, split_manifest, split_summary
from creditloom.operators.split import test_ids as saved_ids
from creditloom.schema import SPLIT_RATIOS, SPLITS

from fixtures import loan_rows, text_frame


def dated(spark, counts, start=datetime.date(2018, 1, 1)):
    rows, n = [], 0
    for i, count in enumerate(counts):
        for _ in range(count):
            rows.append((f"{n:05d}", start + datetime.timedelta(days=31 * i), n % 3 == 0))
            n += 1
    return spark.createDataFrame(rows, "id string, issue_dt date, bad boolean").withColumn("default", F.col("bad").cast("int"))


def walked(counts):
    """The split of each date by walking through them in order."""
    n = sum(counts)
    targets = [int(n * sum(SPLIT_RATIOS[: i + 1])) for i in range(3)]
    out, assigned = [], 0
    for count in counts:
        out.append(SPLITS[sum(assigned >= t for t in targets)])
        assigned += count
    return out


@pytest.mark.parametrize("counts", [[1] * 20, [3] * 4, [1, 1, 1, 1], [90, 1, 1, 1, 7], [1, 1, 1, 97], [5, 60, 5, 5, 5, 20]])
def test_split_equals_the_walk(spark, counts):
    out = split_chronological(dated(spark, counts)).select("issue_dt", "split").distinct().orderBy("issue_dt").collect()
    assert [r["split"] for r in out] == walked(counts)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "string"])
def test_split_by_other_key_types(spark, kind):
    df = dated(spark, [4, 4, 4, 4, 4]).withColumn("issue_dt", F.col("issue_dt").cast(kind))
    out = split_chronological(df).select("issue_dt", "split").distinct().orderBy("issue_dt").collect()
    assert [r["split"] for r in out] == walked([4] * 5)


def test_split_guards(spark):
    df = dated(spark, [2, 2, 2])
    with pytest.raises(ValueError, match="at least 4 distinct"):
        split_chronological(df)
    with pytest.raises(ValueError, match="1 missing values"):
        split_chronological(dated(spark, [1] * 6).withColumn("issue_dt", F.when(F.col("id") != "00000", F.col("issue_dt"))))
    with pytest.raises(ValueError, match="missing split date column"):
        split_chronological(df.drop("issue_dt"))
    with pytest.raises(ValueError, match="sum to 1"):
        split_chronological(df, ratios=(0.5, 0.1, 0.1, 0.1))
    assert split_chronological(df.filter("false")).columns[-1] == "split"


def test_split_is_a_plain_projection(spark):
    plan = split_chronological(dated(spark, [1] * 10).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_summaries(spark):
    df = split_chronological(dated(spark, [1, 1, 1, 1])).withColumn("issue_year", F.when(F.col("id") != "00000", F.year("issue_dt")))
    rows = {r["split"]: r for r in split_summary(df).collect()}
    assert {s: rows[s]["rows"] for s in SPLITS} == {"train": 2, "calibration": 1, "validation": 0, "test": 1}
    assert rows["validation"]["default_rate"] is None and rows["validation"]["date_min"] is None
    manifest = split_manifest(split_summary(df))
    assert manifest["row_counts"]["train"] == 2 and manifest["date_ranges"]["test"]["min"] == "2018-04-04"
    assert manifest["date_ranges"]["validation"] == {"min": None, "max": None}
    assert [r["id"] for r in saved_ids(df).collect()] == ["00003"]
    report = {(r["split"], r["issue_year"]): (r["rows"], r["defaults"], r["non_defaults"]) for r in split_count_report(df).collect()}
    assert report[("train", None)] == (1, 1, 0) and report[("train", 2018)] == (1, 0, 1)


def test_forty_loans(spark):
    df = split_chronological(prepare_loans(text_frame(spark, loan_rows())))
    assert split_manifest(split_summary(df))["row_counts"] == {"train": 24, "calibration": 6, "validation": 6, "test": 4}


def test_folds_expand_over_time(spark):
    rng = random.Random(5)
    counts = [rng.choice([1, 2, 30]) for _ in range(12)]
    df = dated(spark, counts)
    blocked, folds = fold_blocks(df)
    n = sum(counts)
    assert folds == fold_count(n) == 4
    size = n // (folds + 1)
    ids = [r["id"] for r in df.orderBy("issue_dt", "id").collect()]
    got = {r["id"]: r["block"] for r in blocked.collect()}
    for i, identity in enumerate(ids):
        start = n - folds * size
        assert got[identity] == (0 if i < start else (i - start) // size + 1)
    sizes = {r["fold"]: r for r in fold_sizes(blocked, folds).collect()}
    assert [sizes[f]["validation_rows"] for f in (1, 2, 3, 4)] == [size] * 4
    assert sizes[1]["train_rows"] == n - 4 * size and sizes[2]["train_classes"] == 2


def test_no_folds_for_few_rows_or_dates(spark):
    assert fold_blocks(dated(spark, [1] * 7))[1] == 0
    assert fold_blocks(dated(spark, [5, 5, 5]))[1] == 0
    assert fold_count(12) == 2 and fold_count(35) == 3
