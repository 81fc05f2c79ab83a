import pytest
from pyspark.sql import functions as F

from creditloom.operators.prepare import prepare_loans
from creditloom.plans.evaluate import evaluate_locked, evaluate_on_split
from creditloom.plans.score import score
from creditloom.plans.select import TrainingOptions
from creditloom.plans.train import train
from creditloom.schema import FEATURES, SCORE_COLUMNS
from creditloom.sources.bundle import bundle_documents, bundle_errors, load_bundle, load_test_ids, read_json_row, write_json_row

from fixtures import FEATURE_ROW, loan_rows, text_frame

FAST = TrainingOptions(models=["logistic"], model_settings={"logistic": {"maxIter": 5}})


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    source = text_frame(spark, loan_rows()).cache()
    bundle = train(source, root, FAST, context="synthetic_test_fixture")
    return root, source, bundle


def test_training_records_its_provenance(spark, trained):
    root, source, bundle = trained
    meta = load_bundle(spark, f"{root}/bundle").metadata
    assert meta["split_row_counts"] == {"train": 24, "calibration": 6, "validation": 6, "test": 4}
    assert meta["model_version"] == "accepted-default-v1"
    assert meta["artifact_data_context"] == "synthetic_test_fixture"
    assert meta["validation_metrics_summary"]["rows"] == 6
    assert meta["cross_validation_summary"]["selected_model_name"] == meta["selected_model_name"]
    assert len(meta["cross_validation_summary"]["candidate_summaries"]) == 2
    assert len(meta["feature_importance"]) == len(FEATURES)
    assert len(meta["frontend_fields"]) == 5
    compact = load_bundle(spark, f"{root}/compact_bundle")
    assert compact.feature_columns == meta["frontend_fields"]
    assert compact.metadata["model_version"] == "accepted-default-v1-frontend"
    assert set(compact.metadata["frontend_defaults"]) <= set(compact.feature_columns)
    report = read_json_row(spark, f"{root}/reports/validation/metrics_summary")
    assert report["training_timestamp"] == meta["training_timestamp"]
    table = spark.read.option("header", True).csv(f"{root}/reports/validation/model_validation_results")
    assert table.count() == 2
    lift = spark.read.option("header", True).csv(f"{root}/reports/validation/risk_decile_lift")
    assert [int(r[0]) for r in lift.collect()] == list(range(1, 11))


def test_bundle_round_trip_scores_alike_and_keeps_raw_columns(spark, trained):
    root, source, bundle = trained
    raw = source.select("id", *FEATURES)
    loaded = load_bundle(spark, f"{root}/bundle")
    first, second = score(raw, bundle), score(raw, loaded)
    assert first.columns == [*raw.columns, *SCORE_COLUMNS]
    assert first.exceptAll(second).isEmpty()
    assert first.select(*raw.columns).exceptAll(raw).isEmpty()
    assert first.filter(~F.col("p_default").between(0, 1)).isEmpty()


def test_ready_bundles_have_no_errors(spark, trained):
    root, _, _ = trained
    rows = bundle_errors(bundle_documents(spark, [f"{root}/bundle", f"{root}/compact_bundle"])).collect()
    assert [r["errors"] for r in rows] == [[], []]
    broken = spark.createDataFrame([("x", '{"feature_columns": [], "metadata": {"model_version": "v"}}')], "path string, document string")
    errors = bundle_errors(broken).first()["errors"]
    assert "missing calibrator: x" in errors and "missing feature columns: x" in errors
    assert "missing metadata field `split_summary`: x" in errors and len(errors) == 3 + 8


def test_locked_evaluation(spark, trained, tmp_path):
    root, source, bundle = trained
    options = dict(report_root=f"{root}/reports", dataset_root=f"{root}/datasets", logistic_settings={"maxIter": 5})
    metrics = evaluate_locked(spark, f"{root}/bundle", source, **options)
    assert metrics["rows"] == 4 and metrics["evaluation_split"] == "test"
    names = [r["model_name"] for r in metrics["baseline_comparison"]]
    assert names == [bundle.metadata["selected_model_name"], "base_rate", "logistic_regression", "grade_historical_rate", "sub_grade_historical_rate"]
    assert all(r["rows"] == 4 for r in metrics["baseline_comparison"])
    manifest = read_json_row(spark, f"{root}/reports/test/evaluation_manifest")
    assert manifest["locked_test_metrics"]["rows"] == 4

    changed = source.withColumn("annual_inc", F.when(F.col("id") == "1", "999999").otherwise(F.col("annual_inc")))
    with pytest.raises(ValueError, match="fingerprint does not match"):
        evaluate_locked(spark, f"{root}/bundle", changed, **options)
    with pytest.raises(ValueError, match="validation report is missing"):
        evaluate_locked(spark, f"{root}/bundle", source, **{**options, "report_root": str(tmp_path)})

    stale = read_json_row(spark, f"{root}/reports/validation/metrics_summary")
    write_json_row(spark, f"{tmp_path}/stale/validation/metrics_summary", {**stale, "selected_model": "other"})
    with pytest.raises(ValueError, match="does not match locked bundle: selected_model"):
        evaluate_locked(spark, f"{root}/bundle", source, **{**options, "report_root": f"{tmp_path}/stale"})


def test_locked_evaluation_rejects_other_test_ids(spark, trained, tmp_path):
    from creditloom.sources.bundle import save_bundle

    root, source, bundle = trained
    wrong = load_test_ids(spark, f"{root}/bundle").select(F.concat(F.lit("wrong-"), "id").alias("id"))
    path = save_bundle(spark, bundle, f"{tmp_path}/bundle", wrong)
    with pytest.raises(ValueError, match=r"test split IDs do not match.*missing=4, unexpected=4"):
        evaluate_locked(spark, path, source, f"{root}/reports", f"{root}/datasets")
    path = save_bundle(spark, bundle, f"{tmp_path}/bare")
    with pytest.raises(ValueError, match="test split IDs"):
        evaluate_locked(spark, path, source, f"{root}/reports", f"{root}/datasets")


def test_evaluate_on_split_and_validation_only(spark, trained, tmp_path):
    root, source, bundle = trained
    metrics = evaluate_on_split(bundle, source, str(tmp_path), "validation")
    saved = read_json_row(spark, f"{root}/reports/validation/metrics_summary")
    assert metrics["rows"] == 6 and metrics["brier_score"] == pytest.approx(saved["brier_score"])
    options = TrainingOptions(models=["logistic balanced"], calibration_methods=["isotonic"], cross_validation=False, model_settings={"logistic_balanced": {"maxIter": 5}})
    quick = train(source, f"{tmp_path}/quick", options, sample=20, validation_only=True)
    assert quick.metadata["selected_model_name"] == "logistic_balanced"
    assert quick.metadata["cross_validation_summary"]["enabled"] is False
    assert quick.metadata["feature_importance"] == []
    assert quick.metadata["artifact_data_context"] == "smoke_sample"
    assert quick.metadata["sample_rows_requested"] == 20


def test_dataset_is_reused_only_for_the_same_request(spark, trained, tmp_path):
    from creditloom.sources.dataset import prepare_dataset

    _, source, _ = trained
    root = str(tmp_path)
    first, again = prepare_dataset(source, root), prepare_dataset(source, root)
    assert first.path == again.path and again.manifest == first.manifest
    assert prepare_dataset(source, root, sample=10).path != first.path
    other = source.filter("id <> '40'")
    assert prepare_dataset(other, root).path != first.path
    assert first.manifest["row_counts"]["train"] == 24


def test_streamed_scores_equal_batch_scores(spark, trained, tmp_path):
    from creditloom.streaming.scoring import read_requests, score_requests, write_scores

    root, source, bundle = trained
    requests = source.select("id", *FEATURES)
    requests.repartition(4).write.json(f"{tmp_path}/in")
    stream = read_requests(spark, f"{tmp_path}/in", requests.schema, files_per_trigger=1)
    query = write_scores(score_requests(stream, bundle), f"{tmp_path}/out", f"{tmp_path}/checkpoint", available_now=True)
    assert query.awaitTermination(120)
    streamed, batch = spark.read.parquet(f"{tmp_path}/out"), score_requests(requests, bundle)
    assert streamed.count() == 40
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_a_dataset_reads_its_source_once(spark, tmp_path):
    from creditloom.sources.dataset import prepare_dataset

    source = text_frame(spark, loan_rows())
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    first = prepare_dataset(source.mapInPandas(counted, source.schema), str(tmp_path))
    assert read.value == 40 and first.manifest["row_counts"]["train"] == 24
