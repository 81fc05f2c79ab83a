"""Exact quantiles of many columns at once, and right-closed quantile bins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import OrderedTable, counted


def _weighted(low: float, high: float, share: float) -> float:
    """Linear interpolation measured from the nearer end, so that both ends are met exactly."""
    gap = high - low
    return low + gap * share if share < 0.5 else high - gap * (1.0 - share)


def quantiles_of(ordered: OrderedTable, probabilities: dict[tuple, Sequence[float]], count: str = "n") -> dict[tuple, list[float | None]]:
    """Linear quantiles of each group of an ordered table whose single key is the value."""
    (value,) = ordered.keys
    totals = ordered.totals
    places: dict[tuple, dict[float, tuple[int, int, float]]] = {}
    for group, probs in probabilities.items():
        if group not in totals:
            continue
        last = totals[group][count] - 1
        places[group] = {}
        for q in probs:
            h = last * q
            places[group][q] = (math.floor(h), math.ceil(h), h - math.floor(h))
    rows = ordered.rows_at({g: [p for lo, hi, _ in at.values() for p in (lo, hi)] for g, at in places.items()}, count)
    result: dict[tuple, list[float | None]] = {}
    for group, probs in probabilities.items():
        if group not in places:
            result[group] = [None] * len(probs)
            continue
        at = rows[group]
        result[group] = [
            _weighted(float(at[lo][value]), float(at[hi][value]), share)
            for lo, hi, share in (places[group][q] for q in probs)
        ]
    return result


def unpivot_values(df: DataFrame, columns: Sequence[str], dtype: str) -> DataFrame:
    """(feature, value) rows of the given columns, missing values left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(dtype).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).na.drop(subset=["value"])


#: Ranks of the mergeable summary are off by at most one in so many rows.
SUMMARY_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several numeric columns; None for an all-missing column.

    A mergeable summary of each column, whose rank error is known, brackets every wanted rank. Rows below a bracket are
    counted, and only rows inside, about four in SUMMARY_ACCURACY, are ordered. Where a bracket misses its rank, which
    only tables of few rows allow, all rows of the column are inside. ``df`` is read three times, so it should be a written table.
    """
    if not columns:
        return {}
    margin = 2.0 / SUMMARY_ACCURACY
    values = {c: F.col(c).cast("double") for c in columns}
    asked = F.array(*[F.lit(x) for q in probabilities for x in (max(q - margin, 0.0), min(q + margin, 1.0))])
    summary = df.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())],
        *[F.percentile_approx(v, asked, SUMMARY_ACCURACY).alias(f"q{i}") for i, v in enumerate(values.values())],
    ).first()
    brackets = {
        (c, k): (summary[f"q{i}"][2 * k], summary[f"q{i}"][2 * k + 1])
        for i, c in enumerate(columns) for k in range(len(probabilities)) if summary[f"n{i}"]
    }
    rows = {c: summary[f"n{i}"] for i, c in enumerate(columns)}
    found = _inside_brackets(df, values, brackets, rows, probabilities)
    missed = {key: (None, None) for key in brackets if key not in found}
    if missed:
        found.update(_inside_brackets(df, values, missed, rows, probabilities))
    return {c: [found.get((c, k)) for k in range(len(probabilities))] for c in columns}


def _inside_brackets(df: DataFrame, values: dict[str, Column], brackets: dict[tuple, tuple], rows: dict[str, int], probabilities: Sequence[float]) -> dict[tuple, float]:
    """Quantile of each (column, number of the probability) whose bracket (low, high; None: open) holds its ranks."""
    if not brackets:
        return {}
    keys = list(brackets)
    lows = [F.count_if(values[c] < F.lit(brackets[c, k][0])) if brackets[c, k][0] is not None else F.lit(0) for c, k in keys]
    below = df.agg(*[n.alias(str(i)) for i, n in enumerate(lows)]).first()
    ordered = counted(bracket_rows(df, values, brackets), ["value"], ["feature", "number"])
    places = {}
    for i, (c, k) in enumerate(keys):
        h = (rows[c] - 1) * probabilities[k]
        low, high = math.floor(h) - below[i], math.ceil(h) - below[i]
        if low >= 0 and high < ordered.totals.get((c, k), {"n": 0})["n"]:
            places[c, k] = (low, high, h - math.floor(h))
    at = ordered.rows_at({key: [low, high] for key, (low, high, _) in places.items()}, "n")
    return {key: _weighted(float(at[key][low]["value"]), float(at[key][high]["value"]), share) for key, (low, high, share) in places.items()}


def bracket_rows(df: DataFrame, values: dict[str, Column], brackets: dict[tuple, tuple]) -> DataFrame:
    """(feature, number, value) of the values inside the brackets of (column, number)."""

    def inside(c: str, k: int) -> Column:
        low, high = brackets[c, k]
        limits = [values[c].isNotNull()] + ([values[c] >= F.lit(low)] if low is not None else []) + ([values[c] <= F.lit(high)] if high is not None else [])
        return reduce(Column.__and__, limits)

    pairs = [F.when(inside(c, k), F.struct(F.lit(c).alias("feature"), F.lit(k).alias("number"), values[c].alias("value"))) for c, k in brackets]
    return df.select(F.explode(F.array_compact(F.array(*pairs))).alias("v")).select("v.*")


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: values[0] for c, values in exact_quantiles(df, columns, [0.5]).items()}


def even_probabilities(bins: int) -> list[float]:
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def quantile_edges(ordered: OrderedTable, bins: int, count: str = "n", edge_digits: int | None = None) -> dict[tuple, list[float]]:
    """Deduplicated quantile edges of each group, for at most as many bins as rows."""
    totals = ordered.totals
    wanted = {group: even_probabilities(min(bins, row[count])) for group, row in totals.items()}
    edges: dict[tuple, list[float]] = {}
    for group, values in quantiles_of(ordered, wanted, count).items():
        if edge_digits is not None:
            values = [round(v, edge_digits) for v in values]
        edges[group] = sorted(set(values))
    return edges


def quantile_bin(value: Column, edges: Sequence[float]) -> Column:
    """One-based right-closed bin; the lowest edge belongs to bin 1, equal edges give one bin."""
    above = [F.when(value > F.lit(float(e)), 1).otherwise(0) for e in edges[:-1]]
    bin_ = sum(above, F.lit(0)) if above else F.lit(0)
    return F.when(value.isNotNull(), F.greatest(bin_, F.lit(1)))
