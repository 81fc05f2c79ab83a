import random

import pytest
from pyspark.sql import functions as F

from creditloom.operators.ordered import PART, counted, cuts_at, ordered_table
from creditloom.operators.quantiles import exact_medians, exact_quantiles, quantile_bin
from creditloom.plans.importance import DONOR, with_donor
from creditloom.scratch import scratch_root
from creditloom.sources.loans import sample_loans

from test_metrics import brute_metrics, random_rows


@pytest.fixture()
def many_parts(spark):
    """Keep small range partitions apart, as large data would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_over_many_partitions(many_parts):
    rng = random.Random(7)
    rows = [(g, k, rng.randint(1, 5)) for g in "ab" for k in rng.sample(range(1000), 120)]
    df = many_parts.createDataFrame(rows, "g string, k int, n int")
    ordered = ordered_table(df, ["k"], ["n"], ["g"])
    assert len({p[PART] for p in ordered.parts}) > 2
    got = {(r["g"], r["k"]): (r["before_n"], r["total_n"], r["previous_n"]) for r in ordered.running().collect()}
    for g in "ab":
        before, previous = 0, None
        own = sorted((k, n) for gg, k, n in rows if gg == g)
        for k, n in own:
            assert got[(g, k)] == (before, sum(n for _, n in own), previous)
            before, previous = before + n, n


def test_rows_at_positions_read_only_their_partitions(many_parts):
    df = many_parts.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    ordered = ordered_table(df, ["k"], ["n"])
    found = ordered.rows_at({(): [0, 499, 999]}, "n")[()]
    assert {p: r["k"] for p, r in found.items()} == {0: 0, 499: 499, 999: 999}
    number = found[499][PART]
    plan = ordered.running([number])._jdf.queryExecution().executedPlan().toString()
    assert f"PushedFilters: [IsNotNull({PART}), EqualTo({PART},{number})]" in plan


def test_no_single_partition_over_the_rows(many_parts):
    df = many_parts.range(1000).select((F.col("id") % 7).alias("k"))
    running = counted(df, ["k"]).running()
    plan = running._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and f"hashpartitioning({PART}" in plan


@pytest.mark.parametrize("hot", [0.0, 0.34, 1.0])
def test_cuts_split_hot_keys_by_tie_break(many_parts, hot):
    rng = random.Random(3)
    rows = [(50 if rng.random() < hot else rng.randint(0, 99), f"i{rng.random():.8f}") for _ in range(400)]
    df = many_parts.createDataFrame(rows, "k int, id string")
    ordered = sorted(rows)
    places = [0, 1, 133, 200, 399]
    cuts = cuts_at(df, "k", "id", places)
    for place in places:
        at_or_after = df.filter(cuts[place].reached(F.col("k"), F.col("id"))).count()
        assert at_or_after == 400 - place
        assert cuts[place].primary == ordered[place][0]


def test_quantiles_match_linear_interpolation(many_parts):
    numpy = pytest.importorskip("numpy")
    rng = random.Random(11)
    x = [rng.choice([1.0, 2.5, rng.random() * 100]) for _ in range(501)]
    y = [None if i % 3 == 0 else float(i) for i in range(501)]
    df = many_parts.createDataFrame(list(zip(x, y, [None] * 501)), "x double, y double, z double")
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x", "y", "z"], probs)
    assert got["x"] == pytest.approx(list(numpy.quantile(x, probs)))
    assert got["y"] == pytest.approx(list(numpy.quantile([v for v in y if v is not None], probs)))
    assert got["z"] == [None] * 6
    assert exact_medians(many_parts.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double"), ["v"]) == {"v": 2.5}


def test_only_rows_inside_the_brackets_are_ordered(many_parts, monkeypatch):
    from creditloom.operators import quantiles

    seen = []
    inside = quantiles.bracket_rows
    monkeypatch.setattr(quantiles, "bracket_rows", lambda *a: seen.append(inside(*a)) or seen[-1])
    monkeypatch.setattr(quantiles, "SUMMARY_ACCURACY", 200)
    df = many_parts.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id")).alias("y"))
    got = exact_quantiles(df, ["x", "y"], [0.25, 0.5])
    assert got["x"] == [4999.75, 9999.5] and got["y"][0] == 5.0
    assert len(seen) == 1 and seen[0].filter("feature = 'x'").groupBy("number").count().agg(F.max("count")).first()[0] < 900
    assert seen[0].filter("feature = 'x' and number = 1").agg(F.min("value"), F.max("value")).first()[0] > 9000


def test_quantile_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, None)], "v double")
    got = [r[0] for r in df.select(quantile_bin(F.col("v"), [0.0, 1.0, 2.0, 3.0])).collect()]
    assert got == [1, 1, 2, 2, 3, None]


def test_metrics_over_many_partitions(many_parts):
    from creditloom.operators.metrics import metric_rows, score_table

    rows = random_rows(250, 9)
    scores = score_table(many_parts.createDataFrame(rows, "id string, p double, default int"), "p")
    assert len(scores.parts) > 2
    got = metric_rows(scores).first()
    assert (got["roc_auc"], got["pr_auc"]) == pytest.approx(brute_metrics(rows))


def test_donors_are_a_permutation(many_parts):
    df = many_parts.range(300).select(F.col("id").cast("string").alias("id"), F.struct(F.col("id").alias("v")).alias("s"))
    rows = with_donor(df, "s").collect()
    assert sorted(r[DONOR]["v"] for r in rows) == list(range(300))
    assert all(r[DONOR]["v"] != r["s"]["v"] for r in rows)
    again = {r["id"]: r[DONOR]["v"] for r in with_donor(df.repartition(3), "s").collect()}
    assert again == {r["id"]: r[DONOR]["v"] for r in rows}


def test_sample_keeps_every_month_and_its_share(many_parts):
    months = ["2018-01"] * 600 + ["2018-02"] * 300 + ["2018-03"] * 99 + ["2018-04"]
    df = many_parts.createDataFrame([(str(i), m) for i, m in enumerate(months)], "id string, issue_month string")
    sample = sample_loans(df, 100)
    assert {r[0]: r[1] for r in sample.groupBy("issue_month").count().collect()} == {"2018-01": 60, "2018-02": 30, "2018-03": 10, "2018-04": 1}
    assert sample.select("id").distinct().count() == 101
    larger = sample_loans(df, 200)
    assert sample.join(larger, "id", "left_anti").isEmpty()
    assert sample_loans(df, 10_000).count() == 1000
    undated = df.unionByName(many_parts.createDataFrame([("x", None), ("y", None)], df.schema))
    assert sample_loans(undated, 100).filter("issue_month is null").count() == 2


def test_scratch_folder_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_cuts_with_missing_and_repeated_ties(spark):
    from creditloom.operators.ordered import cuts_at

    rows = [(1, None), (1, None), (1, "a"), (1, "b"), (1, "b"), (2, "c"), (2, None)]
    df = spark.createDataFrame(rows, "d int, id string")
    cuts = cuts_at(df, "d", "id", [2, 3, 5, 6])
    for place, cut in cuts.items():
        assert df.filter(~cut.reached(F.col("d"), F.col("id"))).count() == place
    for inside in (1, 4):
        with pytest.raises(ValueError, match="2 rows share d=1"):
            cuts_at(df, "d", "id", [inside])
