import csv
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from creditloom.operators.bands import amount_bands, subgroup_reliability
from creditloom.operators.curves import pr_points, roc_points
from creditloom.operators.lift import risk_decile_lift
from creditloom.operators.metrics import calibration_bins, calibration_summary, merge_scores, metric_rows, risk_thresholds, score_table, summary_of

# Published results for the score distribution below.
GOLDEN = {
    "roc_auc": 0.7091908070791646, "pr_auc": 0.35785214420780054, "brier_score": 0.14628292401105333,
    "log_loss": 0.45675680389072576, "mean_predicted_default": 0.22229555827734876, "actual_default_rate": 0.19885606190373345,
}
GOLDEN_BIN_COUNTS = [16721, 10209, 20366, 7108, 13624, 13452, 15209, 11246, 13856, 12482]
GOLDEN_BIN_RATES = [
    0.04335865079839722, 0.07875404055245372, 0.11047824806049297, 0.1436409679234665, 0.1656635349383441,
    0.19967291109128754, 0.23643895062134263, 0.2825893651075938, 0.34252309468822173, 0.43566736099983977,
]
GOLDEN_LIFT_COUNTS = [13427, 13427, 13427, 13428, 13427, 13427, 13428, 13427, 13427, 13428]


@pytest.fixture(scope="module")
def distribution():
    with open(Path(__file__).parent / "data" / "score_distribution.csv") as f:
        return [(float(r["score"]), int(r["pos"]), int(r["neg"])) for r in csv.DictReader(f)]


@pytest.fixture(scope="module")
def golden(spark, distribution):
    df = spark.createDataFrame(distribution, "p double, pos long, neg long")
    return merge_scores(df.select("p", (F.col("pos") + F.col("neg")).alias("n"), "pos"))


def test_published_metrics(golden):
    row = metric_rows(golden).first()
    assert row["rows"] == 134273
    for name, value in GOLDEN.items():
        assert row[name] == pytest.approx(value, abs=1e-12), name


def test_published_calibration_bins(golden):
    bins = calibration_bins(golden).orderBy("decile").collect()
    assert [b["count"] for b in bins] == GOLDEN_BIN_COUNTS
    assert [b["observed_default_rate"] for b in bins] == pytest.approx(GOLDEN_BIN_RATES, abs=1e-12)
    assert bins[-1]["absolute_calibration_gap"] == pytest.approx(0.0765369800141879, abs=1e-12)


def test_published_curves(golden):
    roc = roc_points(golden).orderBy(F.desc("threshold")).collect()
    assert len(roc) == 166
    assert (roc[0]["fpr"], roc[0]["tpr"], roc[0]["threshold"]) == (0, 0, math.inf)
    assert (roc[1]["fpr"], roc[1]["tpr"], roc[1]["threshold"]) == (pytest.approx(1 / 107572, abs=1e-15), 0, 1.0)
    assert (roc[-1]["fpr"], roc[-1]["tpr"]) == (1, 1)
    pr = pr_points(golden).collect()
    assert len(pr) == 189
    ends = [p for p in pr if p["threshold"] is None]
    assert len(ends) == 1 and (ends[0]["precision"], ends[0]["recall"]) == (1, 0)


def test_published_lift_sizes(spark, distribution):
    pairs = spark.createDataFrame(distribution, "p double, pos long, neg long")
    rows = pairs.select("p", F.explode(F.concat(F.expr("array_repeat(1, int(pos))"), F.expr("array_repeat(0, int(neg))"))).alias("default"))
    rows = rows.withColumn("id", F.monotonically_increasing_id().cast("string"))
    lift = risk_decile_lift(rows, "p").orderBy("predicted_risk_decile").collect()
    assert [r["count"] for r in lift] == GOLDEN_LIFT_COUNTS
    assert lift[-1]["cumulative_share_of_defaults_captured"] == 1.0


def random_rows(n, seed, hot=0.34):
    """Random scored rows; a third of them share one score."""
    rng = random.Random(seed)
    return [(f"k{rng.random():.9f}-{i}", 0.25 if rng.random() < hot else round(rng.random(), 2), int(rng.random() < 0.3)) for i in range(n)]


def brute_metrics(rows):
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0
    for t in sorted({p for _, p, _ in rows}, reverse=True):
        caught, flagged = sum(p >= t for p in pos), sum(p >= t for _, p, _ in rows)
        ap += (caught - last) / len(pos) * caught / flagged
        last = caught
    return auc, ap


@pytest.mark.parametrize("n,seed", [(60, 1), (300, 2)])
def test_metrics_equal_brute_force(spark, n, seed):
    rows = random_rows(n, seed)
    df = spark.createDataFrame(rows, "id string, p double, default int")
    got = metric_rows(score_table(df, "p")).first()
    auc, ap = brute_metrics(rows)
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)
    assert got["brier_score"] == pytest.approx(sum((p - y) ** 2 for _, p, y in rows) / n)


@pytest.mark.parametrize("n,seed", [(3, 3), (13, 4), (200, 5)])
def test_lift_equals_brute_force_under_ties(spark, n, seed):
    rows = random_rows(n, seed)
    df = spark.createDataFrame(rows, "id string, p double, default int")
    got = {r["predicted_risk_decile"]: (r["count"], r["observed_default_rate"]) for r in risk_decile_lift(df, "p").collect()}
    expected = {b: [0, 0] for b in range(1, 11)}
    for rank, (_, _, y) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1):
        b = min(max(math.ceil(rank / n * 10), 1), 10)
        expected[b][0] += 1
        expected[b][1] += y
    assert got == {b: (c, pytest.approx(d / c if c else 0.0)) for b, (c, d) in expected.items()}


def test_lift_without_defaults_or_rows(spark):
    df = spark.createDataFrame([(str(i), i / 20, 0) for i in range(20)], "id string, p double, default int")
    rows = risk_decile_lift(df, "p").collect()
    assert len(rows) == 10
    assert all(r["lift_versus_portfolio_default_rate"] is None and r["cumulative_share_of_defaults_captured"] == 0 for r in rows)
    assert risk_decile_lift(df.filter("false"), "p").isEmpty()


def test_four_points(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.8), (0, 0.2), (1, 0.7)], "default int, p_default double")
    row = calibration_summary(df, bins=2).first()
    assert (row["roc_auc"], row["pr_auc"]) == (1, 1)
    assert row["mean_predicted_default"] == pytest.approx(0.45) and row["actual_default_rate"] == 0.5
    assert [d["count"] for d in row["deciles"]] == [2, 2]


def test_single_class_and_missing_scores(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.4), ("b", 0, None), ("b", 0, 0.3), ("b", 1, 0.3)], "g string, default int, p double")
    rows = {r["g"]: r for r in metric_rows(score_table(df, "p", by=["g"])).collect()}
    assert rows["a"]["roc_auc"] is None and rows["a"]["log_loss"] is None and rows["a"]["brier_score"] == pytest.approx(0.5)
    assert rows["b"]["rows"] == 2 and rows["b"]["roc_auc"] == 0.5
    one = score_table(df.filter("g = 'a'"), "p")
    assert roc_points(one).isEmpty() and pr_points(one).isEmpty()
    with pytest.raises(ValueError, match="no rows with score and target"):
        summary_of(score_table(df.filter("false"), "p"))


def test_equal_scores_form_one_bin(spark):
    df = spark.createDataFrame([(0, 0.2)] * 5 + [(1, 0.2)], "default int, p double")
    bins = calibration_bins(score_table(df, "p")).collect()
    assert [(b["decile"], b["count"]) for b in bins] == [(1, 6)]


def test_bin_numbers_may_have_gaps(spark):
    # Linear edges of these values at fifths: 0, 0, 0.36, 0.72 and 1; bin 1 takes the tied zeros.
    values = [0.0] * 5 + [0.3, 0.6, 0.7, 0.9, 1.0]
    df = spark.createDataFrame([(0, v) for v in values] + [(1, 1.0)], "default int, p double")
    pandas = pytest.importorskip("pandas")
    codes = pandas.qcut(pandas.Series(values + [1.0]), q=5, labels=False, duplicates="drop") + 1
    expected = codes.value_counts().sort_index()
    got = {b["decile"]: b["count"] for b in calibration_bins(score_table(df, "p"), 5).collect()}
    assert got == {int(k): int(v) for k, v in expected.items() if v}


def test_thresholds_and_bands(spark):
    df = spark.createDataFrame([(str(i), i / 9, i % 2, float(100 * i)) for i in range(10)] + [("x", 0.5, 1, None)], "id string, p double, default int, loan_amnt double")
    assert risk_thresholds(score_table(df.filter("id <> 'x'"), "p")) == {"low_max": 0.333333, "medium_max": 0.666667}
    banded = {r["id"]: r for r in amount_bands(df).collect()}
    assert banded["x"]["band"] is None and (banded["0"]["band"], banded["0"]["band_lo"], banded["0"]["band_hi"]) == (1, 0.0, 225.0)
    groups = {(r["dimension"], r["value"]): r["count"] for r in subgroup_reliability(df, "p").collect()}
    assert groups[("loan_amnt_band", "missing")] == 1 and groups[("loan_amnt_band", "4")] == 3
