"""Gapless numbers for rows, without a window over a whole table or a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import materialise

#: Rows that one window group should hold.
BUCKET_ROWS = 100_000


def numbered(df: DataFrame, name: str, order: Sequence[str], by: Sequence[str] = (), rows: Column | int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... within each group of ``by``, in a hashed order of the ``order`` columns.

    Rows are dealt into hash buckets, the buckets of a group are counted, and each bucket is numbered from
    the sum of the buckets before it. ``rows``: rows of the row's group, which decides its buckets. The input
    is read twice, so it should be a written table.
    """
    total = df.count() if rows is None else rows
    total = F.lit(total) if isinstance(total, int) else total
    hashed = F.xxhash64(*order)
    dealt = df.withColumn("__bucket", F.pmod(hashed, F.ceil(total / BUCKET_ROWS) + 1))
    keys = [*by, "__bucket"]
    counts = dealt.groupBy(*keys).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select(*keys, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start")))
    within = Window.partitionBy(*keys).orderBy(hashed, *order)
    ranked = dealt.withColumn("__within", F.row_number().over(within) - 1)
    # Buckets without a group key are few (rows / 100,000), those with one are as many as groups: Spark plans by size.
    return ranked.join(starts, keys).withColumn(name, F.col("__start") + F.col("__within")).drop("__bucket", "__within", "__start")
