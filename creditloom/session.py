"""Session setting the wide cleaning projections are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# HotSpot does not compile methods beyond this size; with the limit Spark splits such a stage into
# smaller methods instead of leaving one large method interpreted.
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def tune(spark: SparkSession) -> SparkSession:
    """Set the limit unless the user has chosen one."""
    if spark.conf.get(_METHOD_LIMIT, "65535") == "65535":
        spark.conf.set(_METHOD_LIMIT, "8000")
    return spark
