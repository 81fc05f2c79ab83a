"""Scoring of arriving requests. Validation and scoring keep no state, so the batch plan is reused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.guards import RECORD_FAULTS, invalid_requests, valid_requests, validate_requests
from ..plans.score import score
from ..sources.bundle import ModelBundle
from ..sources.loans import CSV_READ, DAMAGED


def read_requests(spark: SparkSession, path: str, schema: T.StructType, source_format: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of request files as they arrive in a folder.

    Text formats get a column of faults: records that cannot be parsed, and for JSON fields that are not in the
    schema, are kept and named instead of being read as something else.
    """
    reader = spark.readStream
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if source_format == "json":
        return _json_requests(reader.text(path), schema)
    if source_format == "csv":
        with_fault = T.StructType([*schema.fields, T.StructField(DAMAGED, T.StringType())])
        options = {**CSV_READ, "columnNameOfCorruptRecord": DAMAGED, "columnPruning": False}
        rows = reader.format("csv").options(**options).schema(with_fault).load(path)
        fault = F.when(F.col(DAMAGED).isNotNull(), F.lit("record: cannot be read"))
        return rows.withColumn(RECORD_FAULTS, F.array_compact(F.array(fault))).drop(DAMAGED)
    return reader.format(source_format).schema(schema).load(path)


def _json_requests(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """One JSON object per line; blank lines are no records."""
    mark = "__unreadable"
    parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField(mark, T.StringType())]), {"columnNameOfCorruptRecord": mark})
    rows = lines.filter("trim(value) <> ''").select("value", parsed.alias("r"))
    unknown = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(n) for n in schema.names]))
    named = F.transform(unknown, lambda n: F.concat(n, F.lit(": not a field of a request")))
    unreadable = F.col("r").isNull() | F.col(f"r.{mark}").isNotNull() | F.json_object_keys("value").isNull()
    faults = F.when(unreadable, F.array(F.lit("record: cannot be read"))).otherwise(named)
    return rows.select(*[F.col(f"r.`{n}`") for n in schema.names], faults.alias(RECORD_FAULTS))


def score_requests(requests: DataFrame, bundle: ModelBundle, passthrough: tuple[str, ...] = ("id",)) -> DataFrame:
    """Valid requests with their scores; works on a stream and on a table alike."""
    return score(valid_requests(validate_requests(requests, passthrough)), bundle)


def refuse_requests(requests: DataFrame, passthrough: tuple[str, ...] = ("id",)) -> DataFrame:
    """Invalid requests with their violations, the other half of ``score_requests``."""
    return invalid_requests(validate_requests(requests, passthrough))


def answer_requests(
    requests: DataFrame, bundle: ModelBundle, path: str, checkpoint: str, passthrough: tuple[str, ...] = ("id",), available_now: bool = False
) -> StreamingQuery:
    """Every request in one of two Parquet folders: ``scores``, or ``refused`` with its violations.

    Each batch overwrites its own folders, so a batch that is repeated after a failure counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for name, part in (("scores", score_requests(rows, bundle, passthrough)), ("refused", refuse_requests(rows, passthrough))):
                part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            rows.unpersist()

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_scores(scored: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append scores to Parquet; the checkpoint makes every request file count exactly once."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
