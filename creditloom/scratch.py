"""Intermediate tables in the folder the cluster shares for checkpoints."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where that is not set it is a folder in the session's warehouse, for sessions of one machine only: a cluster has to
    name a folder that all its machines share. A machine-local temporary folder is never used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (configured or spark.conf.get("spark.sql.warehouse.dir") + "/scratch").rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and continue from the files.

    The result has no lineage to recompute: a lost executor re-reads files, and values that depend
    on the physical layout (partition numbers) can never change between two reads.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str], types: Sequence[str]) -> DataFrame:
    """A few driver-side rows as a local relation, whose size Spark knows when it plans a join."""
    kinds = {
        "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(),
        "date": pa.date32(), "timestamp_ntz": pa.timestamp("us"), "timestamp": pa.timestamp("us", "UTC"),
        "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
    }
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    arrays = [pa.array(list(values), type=kinds[t]) for values, t in zip(columns, types)]
    return spark.createDataFrame(pa.table(arrays, names=list(names)))
