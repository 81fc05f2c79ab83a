import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from creditloom.operators.compare import attach_scores, comparison_table, ensure_same_ids, id_set_difference, score_alignment, select_best, top_features
from creditloom.operators.metrics import metric_rows, score_table
from creditloom.plans import boosting, forest, select
from creditloom.plans.calibrate import Calibrator, fit_calibrator
from creditloom.plans.evaluate import data_context
from creditloom.plans.features import VECTOR_COLUMN, fit_feature_stats, linear_encoder, pack_features, tree_encoder
from creditloom.plans.models import fit_encoded, fit_model, predict_raw, vector_name, whole_waves
from creditloom.plans.score import score
from creditloom.plans.select import TrainingOptions
from creditloom.plans.train import field_defaults
from creditloom.scratch import materialise
from creditloom.sources.bundle import ModelBundle
from creditloom.sources.loans import read_scoring_batch
from creditloom.sources.dataset import write_scored

from fixtures import FEATURE_ROW, text_frame


@pytest.fixture(scope="module")
def planted(spark):
    """Rows whose default probability is a known logistic function of dti and grade."""
    base = spark.range(4000, numPartitions=4).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 17 != 0, (F.rand(1) * 60)).alias("dti"),
        F.element_at(F.array(*[F.lit(g) for g in "ABC"]), (F.col("id") % 3 + 1).cast("int")).alias("grade"),
        F.rand(2).alias("u"),
    )
    margin = (F.coalesce("dti", F.lit(30.0)) - 30) / 10 + F.when(F.col("grade") == "C", 1.0).otherwise(-0.5)
    return base.withColumn("true_p", 1 / (1 + F.exp(-margin))).withColumn("default", (F.col("u") < F.col("true_p")).cast("int")).cache()


SETTINGS = {
    "logistic": {"maxIter": 100}, "logistic_balanced": {"maxIter": 100},
    "random_forest": {"numTrees": 10, "maxDepth": 5, "minInstancesPerNode": 20}, "hist_gradient_boosting": {"maxIter": 8},
}


@pytest.mark.parametrize("name", list(SETTINGS))
def test_models_find_the_planted_relation(planted, name):
    model = fit_model(planted, ["dti", "grade"], name, **SETTINGS[name])
    scored = predict_raw(model, planted, ["dti", "grade"])
    assert scored.columns == [*planted.columns, "p_raw"]
    assert scored.filter(~F.col("p_raw").between(0, 1)).isEmpty()
    found = metric_rows(score_table(scored, "p_raw")).first()
    best = metric_rows(score_table(planted, "true_p")).first()
    assert found["roc_auc"] > best["roc_auc"] - 0.02
    if name == "logistic":
        assert found["mean_predicted_default"] == pytest.approx(found["actual_default_rate"], abs=0.005)
    with pytest.raises(ValueError, match="unknown default model candidate"):
        fit_model(planted, ["dti"], "other")
    with pytest.raises(ValueError, match="forbidden"):
        fit_model(planted, ["default"], "logistic")


def test_tree_fits_fill_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for given, expected in ((1, 1), (2, 2), (cores + 1, cores), (2 * cores - 1, 2 * cores)):
        found = whole_waves(spark.range(40 * cores, numPartitions=given))
        sizes = [len(part) for part in found.rdd.glom().collect()]
        assert len(sizes) == expected and sum(sizes) == 40 * cores
        assert max(sizes) - min(sizes) <= given


def test_forest_keeps_the_nodes_of_its_rows(spark):
    rows = spark.range(200, numPartitions=1).select(
        (F.col("id") % 2).cast("double").alias("default"), array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 2).cast("double"))).alias(vector_name("random_forest"))
    )
    settings = dict(numTrees=3, maxDepth=3, minInstancesPerNode=5)
    kept, walked = fit_encoded(rows, "random_forest", **settings), fit_encoded(rows, "random_forest", **settings, cacheNodeIds=False)
    assert kept.getOrDefault("cacheNodeIds")
    trees = lambda model: model.toDebugString.split("\n", 1)[1]
    assert trees(kept) == trees(walked)


def _numbers(spark, partitions):
    """Rows of three features, one of few values and one constant, whose default probability grows with the first two."""
    rows = spark.range(3000, numPartitions=partitions).select(F.rand(3).alias("a"), F.floor(F.rand(4) * 5).alias("b"), F.rand(5).alias("u"))
    vector = array_to_vector(F.array("a", F.col("b").cast("double"), F.lit(7.0)))
    return materialise(rows.select(vector.alias(VECTOR_COLUMN), (F.col("u") < (F.col("a") + F.col("b") / 4) / 2).cast("double").alias("default")))


@pytest.mark.parametrize("depth", [0, 1, 4])
def test_boosted_trees_of_blocks_are_those_of_spark_ml(spark, monkeypatch, tmp_path, depth):
    rows = _numbers(spark, 3)
    estimator = GBTClassifier(featuresCol=VECTOR_COLUMN, labelCol="default", maxBins=256, seed=42, maxIter=6, stepSize=0.3, maxDepth=depth, minInstancesPerNode=40)
    given = estimator.fit(rows)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 500)
    monkeypatch.setattr(boosting, "LINEAGE", 2)
    monkeypatch.setattr(boosting, "whole_waves", lambda r: r.repartition(4))
    grown = []
    monkeypatch.setattr(boosting, "_as_model", lambda *a, made=boosting._as_model: grown.append(a) or made(*a))
    found = boosting.fit_boosted(rows, estimator)
    assert grown and isinstance(found, GBTClassificationModel)
    found.write().save(f"{tmp_path}/model")
    found = GBTClassificationModel.load(f"{tmp_path}/model")
    shape = lambda model: [line.split("Predict")[0] for line in model.toDebugString.split("\n")[1:]]
    assert shape(found) == shape(given) and found.treeWeights == pytest.approx(given.treeWeights)
    assert found.featureImportances.toArray() == pytest.approx(given.featureImportances.toArray(), abs=1e-9)
    scores = lambda model: [r[0][1] for r in model.transform(rows).select("probability").collect()]
    assert scores(found) == pytest.approx(scores(given), abs=1e-9)


def test_boosted_trees_leave_other_settings_and_odd_rows_to_spark_ml(spark, monkeypatch):
    rows = _numbers(spark, 1)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 500)
    monkeypatch.setattr(boosting, "_boosted", lambda *a: pytest.fail("fitted on blocks"))
    settings = dict(featuresCol=VECTOR_COLUMN, labelCol="default", maxIter=1)
    assert boosting.fit_boosted(rows, GBTClassifier(**settings, subsamplingRate=0.5)).getNumTrees == 1
    missing = rows.withColumn("default", F.when(F.col("default") == 1, 1.0))
    with pytest.raises(Exception, match="(?i)label"):
        boosting.fit_boosted(missing, GBTClassifier(**settings))


def _small_blocks(monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 500)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 500)
    monkeypatch.setattr(forest, "COUNT_BYTES", 1)
    monkeypatch.setattr(forest, "whole_waves", lambda r: r.repartition(4))


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_a_tree_of_blocks_is_that_of_spark_ml(spark, monkeypatch, depth):
    rows = _numbers(spark, 3)
    estimator = RandomForestClassifier(featuresCol=VECTOR_COLUMN, labelCol="default", maxBins=256, seed=42, numTrees=1, bootstrap=False, maxDepth=depth, minInstancesPerNode=40)
    given = estimator.fit(rows)
    _small_blocks(monkeypatch)
    found = forest.fit_forest(rows, estimator)
    assert found.toDebugString.split("\n")[1:] == given.toDebugString.split("\n")[1:]
    assert found.featureImportances.toArray() == pytest.approx(given.featureImportances.toArray())
    scores = lambda model: [r[0][1] for r in model.transform(rows).select("probability").collect()]
    assert scores(found) == pytest.approx(scores(given))


def test_a_forest_of_blocks(spark, monkeypatch, tmp_path):
    rows = _numbers(spark, 3)
    estimator = RandomForestClassifier(featuresCol=VECTOR_COLUMN, labelCol="default", maxBins=256, seed=42, numTrees=20, maxDepth=6, minInstancesPerNode=40)
    given = estimator.fit(rows)
    _small_blocks(monkeypatch)
    found, again = forest.fit_forest(rows, estimator), forest.fit_forest(rows, estimator)
    assert found.toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:]
    assert len({t.toDebugString.split("\n", 1)[1] for t in found.trees}) == found.getNumTrees == 20
    found.write().save(f"{tmp_path}/model")
    nodes = spark.read.parquet(f"{tmp_path}/model/data").select("treeID", "nodeData.*").collect()
    by_id = {(n["treeID"], n["id"]): n for n in nodes}
    assert all(n["rawCount"] >= 40 for n in nodes)
    for n in (n for n in nodes if n["leftChild"] >= 0):
        left, right = by_id[n["treeID"], n["leftChild"]], by_id[n["treeID"], n["rightChild"]]
        assert [a + b for a, b in zip(left["impurityStats"], right["impurityStats"])] == n["impurityStats"]
        assert left["leftChild"] >= 0 or right["leftChild"] >= 0 or left["prediction"] != right["prediction"]
    roots = [n["rawCount"] for n in nodes if n["id"] == 0]
    assert len(set(roots)) > 10 and abs(sum(roots) / 20 - 3000) < 60
    auc = lambda model: metric_rows(score_table(model.transform(rows).select("default", vector_to_array("probability")[1].alias("p")), "p")).first()["roc_auc"]
    assert isinstance(RandomForestClassificationModel.load(f"{tmp_path}/model"), RandomForestClassificationModel)
    assert auc(found) == pytest.approx(auc(given), abs=0.02)


def test_draws_are_poisson():
    drawn = forest.drawn_times(np.random.default_rng(1), 1_000_000)
    shares = np.bincount(drawn, minlength=5)[:5] / len(drawn)
    assert shares == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(5)], abs=0.002)


def test_scores_of_the_grid_are_worked_out_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(select, "score_table", lambda scored, p: plans.append(scored._jdf.queryExecution().optimizedPlan().toString()))
    rows = _numbers(spark, 1)
    model = GBTClassifier(featuresCol=VECTOR_COLUMN, labelCol="default", maxIter=1).fit(rows)
    select._scored(model, rows.withColumnRenamed(VECTOR_COLUMN, vector_name("random_forest")), "hist_gradient_boosting")
    assert plans and "UDF" not in plans[0]


def test_candidate_cuts():
    few = boosting.candidate_cuts(np.array([3.0, 1.0, 1.0, 2.0]), 5)
    many = boosting.candidate_cuts(np.repeat(np.arange(100.0), 3), 3)
    assert few.tolist() == [1.5, 2.5] and many.tolist() == [24.5, 49.5, 74.5]
    assert boosting.candidate_cuts(np.zeros(4), 5).tolist() == []


def test_encoders(spark):
    rows = [(1.0, "B", None), (2.0, "A", "x"), (3.0, "B", "x"), (None, None, "y"), (10.0, "A", "y")]
    train = spark.createDataFrame(rows, "dti double, grade string, purpose string")
    features = ["grade", "dti", "purpose"]
    stats = fit_feature_stats(train, features)
    assert stats.medians == {"dti": 2.5} and stats.missing == {"dti": 1}
    assert stats.modes == {"grade": "A", "purpose": "x"} and stats.categories == {"grade": ["A", "B"], "purpose": ["x", "y"]}
    test = spark.createDataFrame([(None, "Z", "y"), (2.5, None, None)], train.schema)
    packed = pack_features(test, features)
    tree = tree_encoder(spark, stats).transform(packed).select(vector_to_array(VECTOR_COLUMN)).collect()
    assert [r[0] for r in tree] == [[2.5, 1, -1, 1], [2.5, 0, 0, 0]]
    linear = [r[0] for r in linear_encoder(packed, stats).transform(packed).select(vector_to_array(VECTOR_COLUMN)).collect()]
    filled = [1.0, 2.0, 3.0, 2.5, 10.0]
    mean = sum(filled) / 5
    deviation = math.sqrt(sum((v - mean) ** 2 for v in filled) / 5)
    scaled = (2.5 - mean) / deviation
    assert linear[0] == pytest.approx([scaled, (1 - 0.2) / 0.4, 0, 0, 0, 1])
    assert linear[1] == pytest.approx([scaled, -0.2 / 0.4, 1, 0, 1, 0])


def test_calibrators(spark):
    points = [(0.1, 0), (0.2, 0), (0.2, 1), (0.4, 0), (0.7, 1), (0.9, 1)]
    df = spark.createDataFrame(points, "p_raw double, default int")
    scores = score_table(df, "p_raw")
    wide = spark.createDataFrame([(-10.0,), (0.1,), (0.3,), (0.5,), (10.0,)], "p_raw double")
    for method in ("isotonic", "sigmoid", "identity"):
        out = [r[0] for r in fit_calibrator(scores, method).apply(wide).select("p_default").collect()]
        assert all(0 <= v <= 1 for v in out) and out == sorted(out), method
    iso = [r[0] for r in fit_calibrator(scores, "isotonic").apply(wide).select("p_default").collect()]
    assert iso == pytest.approx([0, 0, 1 / 3, 1 / 3 + (1 - 1 / 3) / 3, 1])
    one = score_table(df.filter("default = 1"), "p_raw")
    with pytest.raises(ValueError, match="both classes"):
        fit_calibrator(one)
    with pytest.raises(ValueError, match="unknown calibration method"):
        fit_calibrator(scores, "other")


def test_isotonic_blocks_pooled_over_many_partitions(spark, monkeypatch):
    from creditloom.operators.ordered import ordered_table
    from creditloom.plans import calibrate

    monkeypatch.setattr(calibrate, "MERGED", 2)
    rows = spark.range(3000, numPartitions=3).select((F.rand(3) + F.col("id") * 1e-9).alias("p"), F.lit(1).cast("bigint").alias("n"), F.rand(4).alias("u"))
    rows = materialise(rows.withColumn("pos", (F.col("u") < F.col("p")).cast("bigint")).drop("u"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        scores = ordered_table(rows, ["p"], ["n", "pos"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(scores.parts) > 4
    blocks = sorted((r["low"], r["high"], r["n"], r["pos"]) for r in calibrate.pooled_blocks(scores).collect())
    values = sorted((r["p"], r["pos"]) for r in rows.collect())
    kept = []
    for p, pos in values:
        kept.append([p, p, 1, pos])
        while len(kept) > 1 and kept[-2][3] * kept[-1][2] >= kept[-1][3] * kept[-2][2]:
            last = kept.pop()
            kept[-1] = [kept[-1][0], last[1], kept[-1][2] + last[2], kept[-1][3] + last[3]]
    assert blocks == [tuple(b) for b in kept] and len(kept) < 400
    fitted = fit_calibrator(scores, "isotonic").apply(rows.withColumnRenamed("p", "p_raw")).select("p_raw", "p_default").collect()
    steps = {b[0]: b[3] / b[2] for b in kept}
    starts = sorted(steps)
    for r in fitted:
        assert r["p_default"] == pytest.approx(steps[max(s for s in starts if s <= r["p_raw"])])


def test_sigmoid_minimises_the_penalised_loss(spark):
    points = [(0.1, 0)] * 3 + [(0.2, 0), (0.7, 1), (0.9, 1), (0.9, 0)]
    c = fit_calibrator(score_table(spark.createDataFrame(points, "p_raw double, default int"), "p_raw"), "sigmoid")

    def loss(a, b):
        return (a * a + b * b) / 2 + sum(  # the reference's solver penalises the intercept too
            math.log(1 + math.exp(-(1 if y else -1) * (a * p + b))) for p, y in points)

    here = loss(c.slope, c.offset)
    assert all(here <= loss(c.slope + da, c.offset + db) + 1e-6 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def stub(**metadata):
    model = SQLTransformer(statement="SELECT *, 0.1D AS p_raw FROM __THIS__")
    return ModelBundle(model, Calibrator("identity"), ["loan_amnt", "int_rate", "annual_inc", "dti", "fico_range_low"], "stub", metadata)


def test_scoring_with_a_stub(spark):
    df = text_frame(spark, [{"id": "1", **FEATURE_ROW}])
    row = score(df, stub(model_version="v", risk_band_thresholds={"low_max": 0.08, "medium_max": 0.18})).first()
    assert (row["p_default"], row["p_non_default"], row["risk_band"], row["model_version"]) == (0.1, 0.9, "medium", "v")
    assert row["model_type"] == "stub" and row["calibration_method"] is None and row["int_rate"] == "10%"
    assert score(df, stub()).first()["risk_band"] == "medium"
    with pytest.raises(ValueError, match="missing required scoring fields: dti"):
        score(df.drop("dti"), stub())
    bare = stub()
    bare.calibrator = None
    with pytest.raises(ValueError, match="calibrated"):
        score(df, bare)
    bare.feature_columns = ["zip"]
    with pytest.raises(ValueError, match="not among the features"):
        score(df, bare)


def test_scored_csv_keeps_submitted_text(spark, tmp_path):
    rows = [{"id": str(i), **FEATURE_ROW, "emp_length": text} for i, text in enumerate([" 4 years", 'say "x", y', "10+ years"])]
    write_scored(text_frame(spark, rows), f"{tmp_path}/in")
    write_scored(score(read_scoring_batch(spark, f"{tmp_path}/in"), stub()), f"{tmp_path}/out")
    back = read_scoring_batch(spark, f"{tmp_path}/out")
    assert {r["id"]: r["emp_length"] for r in back.collect()} == {r["id"]: r["emp_length"] for r in rows}
    assert back.columns[-6:] == ["p_default", "p_non_default", "risk_band", "model_version", "model_type", "calibration_method"]


def test_bad_scoring_files(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("id,grade\n1,\xe9\n".encode("latin-1"))
    with pytest.raises(ValueError, match="UTF-8"):
        read_scoring_batch(spark, str(tmp_path / "latin.csv"))
    (tmp_path / "empty.csv").write_text("id,grade\n")
    with pytest.raises(ValueError, match="empty"):
        read_scoring_batch(spark, str(tmp_path / "empty.csv"))


def test_scoring_plan_has_no_shuffle_or_python(spark):
    df = text_frame(spark, [{"id": "1", **FEATURE_ROW}])
    plan = score(df, stub())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_training_options():
    assert TrainingOptions(models=["logistic regression", "Histogram-Gradient boosting"]).models == ["logistic", "hist_gradient_boosting"]
    for bad, text in (
        ({"models": ["svm"]}, "unknown model"), ({"models": []}, "no enabled model"), ({"calibration_methods": ["platt"]}, "unknown calibration"),
        ({"models": ["logistic"], "selected_model": "random_forest"}, "selected_model must be"),
    ):
        with pytest.raises(ValueError, match=text):
            TrainingOptions(**bad)


def test_contexts():
    assert data_context(None) == "full_lendingclub_local" and data_context(100) == "smoke_sample"
    assert data_context(None, "synthetic_test_fixture") == "synthetic_test_fixture"
    with pytest.raises(ValueError, match="no such data context"):
        data_context(None, "x")


def test_field_defaults_are_in_raw_units(spark):
    df = spark.createDataFrame([(math.log1p(v), d, g) for v, d, g in ((1000, 10.0, "A"), (3000, 20.0, "B"), (9000, 30.0, "C"))], "loan_amnt double, dti double, grade string")
    assert field_defaults(df, ["loan_amnt", "dti", "grade"]) == {"loan_amnt": pytest.approx(3000), "dti": 20.0}


def test_candidate_order(spark):
    columns = "model_name string, brier_score double, log_loss double, roc_auc double, pr_auc double, mean_absolute_calibration_gap double, cv_mean_absolute_calibration_gap double, cv_mean_brier_score double"
    rows = [
        ("a", 0.2, 0.5, 0.7, 0.3, 0.01, None, None), ("b", 0.2, 0.5, 0.7, 0.3, 0.01, 0.02, 0.1),
        ("c", 0.1, 0.5, 0.7, 0.3, 0.02, 0.02, 0.1), ("d", 0.2, 0.5, None, 0.3, 0.01, 0.02, 0.1),
    ]
    df = spark.createDataFrame(rows, columns)
    assert select_best(df, ["a", "b", "c", "d"]).first()["model_name"] == "b"
    assert select_best(df.filter("model_name in ('a', 'c')"), ["c", "a"]).first()["model_name"] == "a"
    assert select_best(df, ["a", "b", "c", "d"], "c").first()["model_name"] == "c"
    assert comparison_table(df).first()["model_name"] == "c"
    top = spark.createDataFrame([("x", -0.3), ("y", 0.1), ("z", 0.2)], "feature string, importance double")
    assert [r["feature"] for r in top_features(top, 2).collect()] == ["x", "z"]


def test_id_sets(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    right = spark.createDataFrame([("2",), ("3",), ("4",), ("4",)], "id string")
    row = id_set_difference(left, right).first()
    assert (row["missing"], row["unexpected"]) == (1, 1)
    with pytest.raises(ValueError, match="missing=1, unexpected=1"):
        ensure_same_ids(left, right)
    ensure_same_ids(left, left.select(F.col("id").cast("string")))
    scores = spark.createDataFrame([(3, 0.3), (1, 0.1)], "id int, p double")
    assert sorted(tuple(r) for r in attach_scores(left, scores).collect()) == [(1, 0.1), (2, None), (3, 0.3)]
    assert tuple(score_alignment(left, scores.union(scores.filter("id = 1"))).first()) == (1, 1, 0)
    with pytest.raises(ValueError, match="1 ids have more than one score"):
        attach_scores(left, scores.union(scores.filter("id = 1")))


def test_candidate_grid_runs_the_whole_job(spark, monkeypatch):
    from checks import evaluation

    seen = []

    def noted(train, calibration, validation, features, options=None):
        seen.append((list(features), options))
        return None, []

    monkeypatch.setattr(evaluation, "select_candidate", noted)
    evaluation.candidate_grid(spark, "/root/testdata/sf0.001")
    (features, options), = seen
    assert features == list(evaluation.FEATURES) and options == evaluation.TrainingOptions() and options.cross_validation
