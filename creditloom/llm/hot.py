"""Joins of a large table with one row for each of its keys, where single keys may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: A key that holds more than one in so many rows is joined apart, so there are at most so many of them.
HOT_KEYS = 1000
#: Fewer rows than this are no hot key.
LEAST_HOT = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """``left`` joined (inner) with ``right``, which has each key once and in ``n`` the rows that ``left`` has of it.

    Keys with more than LEAST_HOT rows and more than one in HOT_KEYS of all rows are at most HOT_KEYS rows of ``right``:
    they are broadcast, so their rows stay where they are. All others are shuffled, at every size. Keys are not null.
    Both tables are read more than once, so they should be written ones.
    """
    most, total = right.agg(F.max(n), F.sum(n)).first()
    limit = max(LEAST_HOT, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return left.join(right.hint("merge"), list(keys))
    hot, cold = F.broadcast(right.filter(F.col(n) > limit)), right.filter(F.col(n) <= limit)
    rest = left.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    return left.join(hot, list(keys)).unionByName(rest.join(cold.hint("merge"), list(keys)))
