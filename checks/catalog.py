"""One entry per operator: the Spark query and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from creditloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; floating results are rounded to six digits."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(f(tune(spark), folder))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    # Adding zero turns a negative zero into zero.
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in doubles else F.col(c) for c in df.columns])
