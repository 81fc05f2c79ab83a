"""Loan sources: CSV and Parquet scans, and samples that keep every issue month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..operators.ordered import ordered_table
from ..schema import FEATURES, KEY_COLUMNS
from ..scratch import local_rows


# A quote inside a quoted field is doubled, and outer blanks belong to the field.
CSV_READ = {"header": True, "quote": '"', "escape": '"'}
CSV_WRITE = {**CSV_READ, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


#: Text of a record that does not have the fields of the header; NULL for all others.
DAMAGED = "_damaged_record"


def read_csv_text(spark: SparkSession, path: str, mode: str = "PERMISSIVE", multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column as text. The header is the only thing read ahead.

    Types are never inferred: that would scan everything and still guess. In ``PERMISSIVE`` mode the column
    ``DAMAGED`` holds the text of records with too few or too many fields; for that all fields have to be
    parsed. ``multi_line`` reads line breaks inside quotes, at the price of one task for each file.
    """
    options = {**CSV_READ, "multiLine": multi_line}
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if mode == "PERMISSIVE":
        schema = schema.add(DAMAGED, T.StringType())
        options |= {"columnNameOfCorruptRecord": DAMAGED, "columnPruning": False}
    return spark.read.options(**options, mode=mode).schema(schema).csv(path)


def damaged_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The records of a CSV file or folder that do not have the fields of its header, as (record)."""
    df = read_csv_text(spark, path, multi_line=multi_line)
    # Spark does not read the text of damaged records alone; nothing of the first field is added to it.
    record = F.concat(F.col(DAMAGED), F.left(F.coalesce(F.col(f"`{df.columns[0]}`"), F.lit("")), F.lit(0)))
    return df.filter(F.col(DAMAGED).isNotNull()).select(record.alias("record"))


def read_loans(
    spark: SparkSession, path: str, features: Sequence[str] = FEATURES, source_format: str = "csv", multi_line: bool = False
) -> DataFrame:
    """Only the needed columns of a loan file or folder; absent ones are tolerated.

    A damaged CSV record fails the job that reads it, with its text; ``damaged_records`` lists them all. A line
    break inside a quoted field damages its record unless ``multi_line`` is set.
    """
    if source_format != "csv":
        return select_loan_columns(spark.read.format(source_format).load(path), features)
    df = read_csv_text(spark, path, multi_line=multi_line)
    message = F.concat(F.lit("damaged CSV record: "), F.col(DAMAGED))
    whole = F.when(F.col(DAMAGED).isNull(), True).otherwise(F.raise_error(message).cast("boolean"))
    return select_loan_columns(df.filter(whole), features)


def select_loan_columns(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    needed = {*features, *KEY_COLUMNS}
    return df.select(*[c for c in df.columns if c in needed])


def ensure_utf8(spark: SparkSession, path: str) -> None:
    """Reject text files with bytes that are not UTF-8 (the CSV reader would replace them)."""
    if not spark.read.text(path).filter(~F.is_valid_utf8("value")).isEmpty():
        raise ValueError("uploaded CSV must be UTF-8 encoded")


def read_scoring_batch(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows to score, unchanged; empty input, bad encoding and malformed rows are errors."""
    ensure_utf8(spark, path)
    df = read_csv_text(spark, path, mode="FAILFAST")
    if not df.columns or df.isEmpty():
        raise ValueError("uploaded CSV is empty")
    return df


def first_rows(df: DataFrame, n: int, id_column: str = "id") -> DataFrame:
    """The first ``n`` rows in id order."""
    return df.orderBy(id_column).limit(n)


def sample_loans(df: DataFrame, n: int, seed: int = 42, month: str = "issue_month", id_column: str = "id") -> DataFrame:
    """About ``n`` rows, spread over all months by their share, at least one row each.

    In every month the rows with the smallest hash of (id, seed) are taken, so a sample is the same
    on every run and grows with ``n``. Rows are counted per month and hash prefix; the month's quota
    then ends inside one prefix, and only the rows of that prefix have to be ordered. Rows without a
    month all stay, so that a later split still reports them.
    """
    digest = F.md5(F.concat_ws("#", F.col(id_column).cast("string"), F.lit(str(seed))))
    marked = df.withColumn("__hash", digest).withColumn("__prefix", F.substring("__hash", 1, 3))
    counts = marked.groupBy(month, "__prefix").agg(F.count("*").alias("n"))
    by_prefix = ordered_table(counts.na.drop(subset=[month]), ["__prefix"], ["n"], [month])
    totals = by_prefix.totals  # one row per calendar month
    rows = sum(t["n"] for t in totals.values())
    quota = {m: max(1, -(-n * t["n"] // rows)) for m, t in totals.items()}
    at = by_prefix.rows_at({m: [min(q, totals[m]["n"]) - 1] for m, q in quota.items()}, "n")
    # One row per month: the prefix where its quota ends and how many rows that prefix may give.
    ends = [(m[0], row["__prefix"], p + 1 - row["before_n"]) for m, found in at.items() for p, row in found.items()]
    kind = df.schema[month].dataType.simpleString()
    limits = local_rows(df.sparkSession, ends, [month, "__end", "__take"], [kind, "string", "bigint"])
    near = marked.join(F.broadcast(limits), month).filter(F.col("__prefix") <= F.col("__end"))
    inside = near.filter(F.col("__prefix") < F.col("__end"))
    last = near.filter(F.col("__prefix") == F.col("__end")).withColumn("n", F.lit(1))
    ordered = ordered_table(last, ["__hash", id_column], ["n"], [month]).running()
    taken = ordered.filter(F.col("before_n") < F.col("__take"))
    undated = df.filter(F.col(month).isNull())
    return inside.select(*df.columns).unionByName(taken.select(*df.columns)).unionByName(undated)


def _field(name: str) -> Column:
    """A value with its length in front, so fields cannot run into each other; a NULL is a sign no text can spell."""
    text = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def source_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Content fingerprint of a table as one row: hash of names and types, row count, and four sums of row-hash words.

    One pass with map-side sums. Row order does not matter, repeated rows count, and a NULL differs from any
    text. The sums are decimals: words of 32 bits of any number of rows that a table can hold fit.
    """
    columns = list(columns or sorted(df.columns))
    layout = "".join(f"{len(c)}:{c}:{df.schema[c].dataType.simpleString()};" for c in columns)
    digest = F.md5(F.concat(*[_field(c) for c in columns]))

    def word(i: int) -> Column:
        return F.conv(F.substring(F.col("h"), 1 + 8 * i, 8), 16, 10).cast("bigint")

    # Summed as whole numbers in 256 groups of hashes, each of which holds two billion rows, then as decimals.
    per_group = df.select(digest.alias("h")).groupBy(F.substring("h", 1, 2).alias("g")).agg(
        F.count("*").alias("rows"), *[F.sum(word(i)).alias(f"word{i + 1}") for i in range(4)]
    )
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(28,0)")), F.lit(0))
    return per_group.agg(
        F.md5(F.lit(layout)).alias("layout"), total("rows").cast("bigint").alias("rows"),
        *[total(f"word{i + 1}").cast("string").alias(f"word{i + 1}") for i in range(4)],
    )


def fingerprint_text(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    row = source_fingerprint(df, columns).first()
    return "-".join(str(row[c]) for c in ("layout", "rows", "word1", "word2", "word3", "word4"))
