"""Model bundles: a folder with the pipeline, the calibrator, one metadata row and the test ids."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import REQUIRED_METADATA
from .loans import fingerprint_text


@dataclass
class ModelBundle:
    """A fitted model with what the saved document of its folder says about it."""

    model: Transformer
    calibrator: Any
    feature_columns: list[str]
    model_type: str
    metadata: dict = field(default_factory=dict)
    required_input_schema: dict = field(default_factory=dict)

    def document(self) -> dict:
        """What is saved beside the model; a bundle without a training time is stamped when it is saved."""
        if "training_timestamp" not in self.metadata:
            self.metadata["training_timestamp"] = datetime.now(timezone.utc).isoformat()
        c = self.calibrator
        return {
            "feature_columns": self.feature_columns,
            "model_type": self.model_type,
            "metadata": self.metadata,
            "required_input_schema": self.required_input_schema,
            "calibrator": None if c is None else {"method": c.method, "slope": c.slope, "offset": c.offset},
        }


def write_json_row(spark: SparkSession, path: str, row: dict, mode: str = "overwrite") -> None:
    """One JSON document, written by Spark so that any file system it knows will do."""
    text = json.dumps(row, default=str)
    spark.range(1).select(F.lit(text).alias("value")).write.mode(mode).text(path)


def read_json_row(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_bundle(spark: SparkSession, bundle: ModelBundle, path: str, test_ids: DataFrame | None = None) -> str:
    from ..plans.calibrate import Calibrator

    model = bundle.model if isinstance(bundle.model, PipelineModel) else PipelineModel([bundle.model])
    model.write().overwrite().save(f"{path}/model")
    calibrator: Calibrator | None = bundle.calibrator
    if calibrator is not None and calibrator.model is not None:
        calibrator.model.write().overwrite().save(f"{path}/calibrator")
    if test_ids is not None:
        test_ids.write.mode("overwrite").parquet(f"{path}/test_ids")
    write_json_row(spark, f"{path}/bundle", bundle.document())
    return path


def load_bundle(spark: SparkSession, path: str) -> ModelBundle:
    from ..plans.calibrate import Calibrator

    document = read_json_row(spark, f"{path}/bundle")
    saved = document["calibrator"]
    calibrator = None
    if saved is not None:
        model = IsotonicRegressionModel.load(f"{path}/calibrator") if saved["method"] == "isotonic" else None
        calibrator = Calibrator(saved["method"], model, saved["slope"], saved["offset"])
    return ModelBundle(
        PipelineModel.load(f"{path}/model"), calibrator, document["feature_columns"],
        document["model_type"], document["metadata"], document["required_input_schema"],
    )


def load_test_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/test_ids")


def bundle_fingerprint(spark: SparkSession, path: str) -> str:
    """Hash over the content of all files of a saved bundle, whatever their order and names of parts.

    Files are hashed where they are read; only one row of sums leaves the executors.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return fingerprint_text(files.select(F.sha2("content", 256).alias("content"), "length"))


def bundle_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, document) rows of many bundles, for checks across a model store; an absent bundle has no document."""
    found = None
    for path in paths:
        wanted = spark.range(1).select(F.lit(path).alias("path"))
        try:
            text = spark.read.text(f"{path}/bundle").select(F.col("value").alias("document"))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            text = spark.range(0).select(F.lit("").alias("document"))
        row = wanted.join(text, F.lit(True), "left")
        found = row if found is None else found.unionByName(row)
    return found


def bundle_errors(documents: DataFrame) -> DataFrame:
    """Add ``errors``: what each bundle lacks before it may serve (empty when ready).

    A field counts as missing when absent, null, or an empty text, list or object. A bundle without a document
    lacks itself.
    """
    # Each document is parsed once; nested values stay as their JSON text.
    fields = ", ".join(f"{name}: string" for name in REQUIRED_METADATA)
    schema = f"calibrator string, feature_columns string, required_input_schema string, metadata struct<{fields}>"
    parsed = documents.withColumn("__parsed", F.from_json("document", schema))
    absent = lambda p: F.coalesce(F.col(f"__parsed.{p}"), F.lit("")).isin("", "[]", "{}", "0", "false", "null")
    checks = [
        (absent("calibrator"), "missing calibrator"),
        (absent("feature_columns"), "missing feature columns"),
        (absent("required_input_schema"), "missing required input schema"),
        *[(absent(f"metadata.{f}"), f"missing metadata field `{f}`") for f in REQUIRED_METADATA],
    ]
    messages = [F.when(bad, F.concat(F.lit(text + ": "), F.col("path"))) for bad, text in checks]
    lacking = F.array(F.concat(F.lit("missing artifact: "), F.col("path")))
    errors = F.when(F.col("document").isNull(), lacking).otherwise(F.array_compact(F.array(*messages)))
    return parsed.withColumn("errors", errors).drop("__parsed")
