"""Permutation importance in one pass over the scored rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.metrics import brier
from ..operators.ordered import PART, ordered_table
from ..schema import TARGET
from ..scratch import local_rows
from .features import FEATURES_COLUMN

DONOR = "__donor"
_BASELINE = ""


def with_donor(df: DataFrame, value: str, id_column: str = "id", seed: int = 42) -> DataFrame:
    """Give every row the ``value`` of the next row in a pseudo-random order of the ids.

    The order is that of a hash of (id, seed), the last row takes from the first, so the donors are
    a permutation. Rows are ordered once, by range partitions; only the first row of each range
    partition has to be carried to its neighbour.
    """
    digest = F.md5(F.concat_ws("#", F.col(id_column).cast("string"), F.lit(str(seed))))
    laid_out = ordered_table(df.withColumns({"__hash": digest, "n": F.lit(1)}), ["__hash", id_column], ["n"])
    numbers = sorted(p[PART] for p in laid_out.parts)
    follows = local_rows(df.sparkSession, list(zip(numbers, numbers[1:] + numbers[:1])), [PART, "__next"], ["int", "int"])
    firsts = laid_out.table.groupBy(PART).agg(
        F.min_by(F.struct(value), F.struct("__hash", id_column)).alias("__first")
    )
    # One row per range partition.
    carried = follows.join(firsts.withColumnRenamed(PART, "__next"), "__next").select(PART, "__first")
    order = Window.partitionBy(PART).orderBy("__hash", id_column)
    own = F.lead(F.struct(value)).over(order)
    return (
        laid_out.table.join(F.broadcast(carried), PART)
        .withColumn(DONOR, F.coalesce(own, F.col("__first"))[value])
        .select(*df.columns, DONOR)
    )


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], DataFrame], features: Sequence[str], target: str = TARGET, id_column: str = "id", seed: int = 42) -> DataFrame:
    """Brier change when one feature's values are permuted, for every feature.

    ``df`` holds the feature struct; ``score`` adds ``p_default`` from it. Each row is scored once
    per feature with that feature taken from its donor, and once unchanged.
    """
    rows = with_donor(df.select(id_column, target, FEATURES_COLUMN), FEATURES_COLUMN, id_column, seed)
    variants = rows.select(
        target, FEATURES_COLUMN, DONOR, F.explode(F.array(*[F.lit(f) for f in (_BASELINE, *features)])).alias("feature")
    )
    fields = df.schema[FEATURES_COLUMN].dataType.fieldNames()
    pick = lambda f: F.when(F.col("feature") == f, F.col(f"{DONOR}.{f}")).otherwise(F.col(f"{FEATURES_COLUMN}.{f}"))
    permuted = variants.select(
        target, "feature", F.struct(*[(pick(f) if f in features else F.col(f"{FEATURES_COLUMN}.{f}")).alias(f) for f in fields]).alias(FEATURES_COLUMN)
    )
    losses = score(permuted).groupBy("feature").agg(brier(F.col("p_default"), F.col(target)).alias("brier"))
    # One row per feature.
    baseline = F.max(F.when(F.col("feature") == _BASELINE, F.col("brier"))).over(Window.partitionBy(F.lit(0)))
    return (
        losses.withColumn("importance", F.col("brier") - baseline)
        .filter(F.col("feature") != _BASELINE)
        .select("feature", "importance")
    )
