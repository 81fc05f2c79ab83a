"""The prepared, split dataset as Parquet, and scored or report output."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.prepare import prepare_loans
from ..operators.split import split_chronological, split_manifest, split_summary, test_ids
from ..operators.target import target_summary
from ..schema import FEATURES
from ..scratch import materialise
from .bundle import read_json_row, write_json_row
from .loans import CSV_WRITE, fingerprint_text, sample_loans, select_loan_columns


@dataclass
class LoanDataset:
    """Prepared loans with their split, and what was recorded when they were prepared."""

    loans: DataFrame
    fingerprint: str
    manifest: dict
    split_rows: list[dict]
    target_summary: dict
    features: list[str]
    sample: int | None
    path: str | None = None

    def split(self, name: str) -> DataFrame:
        return self.loans.filter(self.loans.split == name)

    def test_ids(self) -> DataFrame:
        return test_ids(self.loans)


def dataset_key(fingerprint: str, sample: int | None, features: Sequence[str]) -> str:
    """Folder name for one source content, sample request and feature list."""
    return hashlib.sha256(json.dumps([fingerprint, sample, list(features)]).encode()).hexdigest()[:32]


def prepare_dataset(source: DataFrame, root: str, features: Sequence[str] = FEATURES, sample: int | None = None, fingerprint: str | None = None) -> LoanDataset:
    """Prepared dataset of ``source`` under ``root``, reused when the very same request was written.

    The folder name is derived from content, sample and features, and a summary file is written
    last, so a folder is either complete and right or not used at all.

    The source is read once, into a columnar copy of its needed columns. Fingerprint, status check, dates, and target counts are read
    from that, each only the columns it needs.
    """
    spark = source.sparkSession
    raw = select_loan_columns(source, features)
    if fingerprint is None:
        raw, staged = materialise(raw), True
        fingerprint = fingerprint_text(raw)
    else:
        staged = False
    path = f"{root.rstrip('/')}/{dataset_key(fingerprint, sample, features)}"
    cached = load_dataset(spark, path)
    if cached is not None:
        return cached
    raw = raw if staged else materialise(raw)
    prepared = prepare_loans(raw)
    if sample is not None:
        prepared = sample_loans(prepared, sample)
    split_chronological(prepared).write.mode("overwrite").partitionBy("split").parquet(f"{path}/loans")
    loans = _read_loans(spark, path)
    split_rows = [r.asDict() for r in split_summary(loans).collect()]  # four rows
    record = {
        "fingerprint": fingerprint,
        "manifest": split_manifest(split_rows),
        "split_rows": split_rows,
        "target_summary": target_summary(raw).first().asDict(),
        "features": list(features),
        "sample": sample,
    }
    write_json_row(spark, f"{path}/record", record)
    return load_dataset(spark, path)


def _read_loans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/loans")


def load_dataset(spark: SparkSession, path: str) -> LoanDataset | None:
    try:
        record = read_json_row(spark, f"{path}/record")
    except AnalysisException:  # no record: never written, or not to the end
        return None
    return LoanDataset(_read_loans(spark, path), path=path, **record)


def write_scored(df: DataFrame, path: str, output_format: str = "csv") -> str:
    """Scored rows as a folder of files, one per task; nothing is gathered.

    Submitted text is written as it came: the CSV writer would otherwise trim outer blanks.
    """
    writer = df.write.mode("overwrite").format(output_format)
    (writer.options(**CSV_WRITE) if output_format == "csv" else writer).save(path)
    return path


def write_report(df: DataFrame, path: str, output_format: str = "csv") -> str:
    """A report table (some hundred rows) as one file in a folder."""
    return write_scored(df.coalesce(1), path, output_format)
