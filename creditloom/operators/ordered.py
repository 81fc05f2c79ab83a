"""Global order, running totals and exact selection without a single-partition window.

Everything that needs a rank (AUC, quantiles, deciles, split and fold cuts) works on an *ordered
table*: rows aggregated per key first, so that a value shared by a third of all rows is one row,
then laid out by Spark's range partitioning and written once. Each range partition carries its
number, so running totals are a window inside the partition plus an offset from one small row per
partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..scratch import local_rows, materialise

PART = "__part"


@dataclass
class OrderedTable:
    """``table`` spread by (``by``, ``keys``) over numbered range partitions.

    The groups of ``by`` must be few and known (models, features, months): their totals per range
    partition are kept on the driver.
    """

    table: DataFrame
    by: tuple[str, ...]
    keys: tuple[str, ...]
    sums: tuple[str, ...]

    @cached_property
    def parts(self) -> list[dict]:
        """Totals of each range partition, the totals before it, and the last row before it.

        At most (range partitions + groups) small rows, whatever the table size.
        """
        rows = (
            self.table.groupBy(*self.by, PART)
            .agg(
                *[F.sum(s).cast("bigint").alias(s) for s in self.sums],
                F.max_by(F.struct(*self.sums), F.struct(*self.keys)).alias("last"),
            )
            .collect()
        )
        groups: dict[tuple, list[Row]] = {}
        for row in sorted(rows, key=lambda r: r[PART]):
            groups.setdefault(tuple(row[b] for b in self.by), []).append(row)
        result = []
        for group, members in groups.items():
            before, previous = dict.fromkeys(self.sums, 0), None
            total = {s: sum(m[s] for m in members) for s in self.sums}
            for m in members:
                result.append(
                    {"group": group, PART: m[PART], "before": dict(before), "size": m, "total": total, "previous": previous}
                )
                before = {s: before[s] + m[s] for s in self.sums}
                previous = m["last"]
        return result

    @property
    def totals(self) -> dict[tuple, dict[str, int]]:
        return {p["group"]: p["total"] for p in self.parts}

    def _type(self, column: str) -> str:
        return self.table.schema[column].dataType.simpleString()

    def running(self, numbers: Sequence[int] | None = None) -> DataFrame:
        """Rows with ``before_<s>`` (sum over smaller keys), ``total_<s>`` and ``previous_<s>``.

        With ``numbers`` only those range partitions are read, as a filter of the Parquet scan.
        """
        parts = [p for p in self.parts if numbers is None or p[PART] in set(numbers)]
        rows = self.table if numbers is None else self.table.filter(F.col(PART).isin(*numbers))
        values = [
            (
                *p["group"],
                p[PART],
                *[p["before"][s] for s in self.sums],
                *[p["total"][s] for s in self.sums],
                *[p["previous"][s] if p["previous"] is not None else None for s in self.sums],
            )
            for p in parts
        ]
        names = [f"__{kind}_{s}" for kind in ("offset", "total", "previous") for s in self.sums]
        types = [*[self._type(b) for b in self.by], "int", *["bigint"] * len(names)]
        if len(values) == 1 and not self.by:
            rows = rows.withColumns({n: F.lit(v).cast("bigint") for n, v in zip(names, values[0][1:])})
        else:
            offsets = local_rows(rows.sparkSession, values, [*self.by, PART, *names], types)
            rows = rows.join(F.broadcast(offsets), [*self.by, PART])  # bounded as `parts` is
        within = Window.partitionBy(*self.by, PART).orderBy(*self.keys)
        earlier = within.rowsBetween(Window.unboundedPreceding, -1)
        computed = {}
        for s in self.sums:
            computed[f"before_{s}"] = F.coalesce(F.sum(s).over(earlier), F.lit(0)) + F.col(f"__offset_{s}")
            computed[f"total_{s}"] = F.col(f"__total_{s}")
            computed[f"previous_{s}"] = F.coalesce(F.lag(s).over(within), F.col(f"__previous_{s}"))
        return rows.withColumns(computed).drop(*names)

    def rows_at(self, positions: dict[tuple, Iterable[int]], count: str) -> dict[tuple, dict[int, Row]]:
        """Rows that cover the given zero-based positions of each group, counting ``count`` per row.

        Only the range partitions that hold a wanted position are read.
        """
        wanted = []
        for part in self.parts:
            start = part["before"][count]
            end = start + part["size"][count]
            inside = sorted({int(p) for p in positions.get(part["group"], ()) if start <= p < end})
            if inside:
                wanted.append((*part["group"], part[PART], inside))
        found: dict[tuple, dict[int, Row]] = {group: {} for group in positions}
        if not wanted:
            return found
        types = [*[self._type(b) for b in self.by], "int", "array<bigint>"]
        targets = local_rows(self.table.sparkSession, wanted, [*self.by, PART, "__positions"], types)
        numbers = sorted({w[len(self.by)] for w in wanted})
        begin, size = F.col(f"before_{count}"), F.col(count)
        hits = (
            self.running(numbers)
            .join(F.broadcast(targets), [*self.by, PART])  # one row per part that holds a wanted position
            .withColumn("__positions", F.filter("__positions", lambda p: (p >= begin) & (p < begin + size)))
            .filter(F.size("__positions") > 0)
        )
        for row in hits.collect():  # at most one row per wanted position
            for place in row["__positions"]:
                found[tuple(row[b] for b in self.by)][place] = row
        return found


def ordered_table(df: DataFrame, keys: Sequence[str], sums: Sequence[str], by: Sequence[str] = ()) -> OrderedTable:
    """Lay ``df`` out by (``by``, ``keys``), which must be unique, and write it once.

    The partition number is stored with the row, so it stays the same however often files are read.
    """
    laid_out = df.repartitionByRange(*by, *keys).withColumn(PART, F.spark_partition_id())
    return OrderedTable(materialise(laid_out), tuple(by), tuple(keys), tuple(sums))


def counted(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> OrderedTable:
    """Ordered table of the distinct keys with their row counts ``n``."""
    return ordered_table(df.groupBy(*by, *keys).agg(F.count("*").alias("n")), keys, ["n"], by)


@dataclass
class Cut:
    """First row at or after a position in (primary, tie-break) order; ``whole``: it is the first row of its key."""

    primary: object
    tie: object = None
    whole: bool = False

    def reached(self, primary: Column, tie: Column) -> Column:
        """Whether a row stands at or after the cut; a missing tie-break stands before all others."""
        value = F.lit(self.primary)
        if self.whole:
            return primary >= value
        return (primary > value) | ((primary == value) & F.coalesce(tie >= F.lit(self.tie), F.lit(False)))


def cuts_at(df: DataFrame, primary: str, tie: str, positions: Iterable[int]) -> dict[int, Cut]:
    """Exact cut keys at zero-based positions of the order (``primary``, ``tie``).

    Primary keys are counted first. Only keys that straddle a wanted position have their tie-breaks counted and
    ordered, over as many range partitions as they need. A position inside rows with the same key and
    tie-break (repeated or missing ids) has no cut key; that is an error which names how many rows they are.
    """
    places = sorted({int(p) for p in positions})
    hits = counted(df, [primary]).rows_at({(): places}, "n")[()]
    cuts: dict[int, Cut] = {}
    straddling: dict[object, list[tuple[int, int]]] = {}
    for place, row in hits.items():
        if row["before_n"] == place:
            cuts[place] = Cut(row[primary], whole=True)
        else:
            straddling.setdefault(row[primary], []).append((place, place - row["before_n"]))
    if straddling:
        ties = counted(df.filter(F.col(primary).isin(*straddling)), [tie], [primary])
        wanted = {(key,): [offset for _, offset in pairs] for key, pairs in straddling.items()}
        for (key,), rows_by_offset in ties.rows_at(wanted, "n").items():
            for place, offset in straddling[key]:
                row = rows_by_offset[offset]
                if row["before_n"] != offset:
                    raise ValueError(f"{row['n']} rows share {primary}={key} and {tie}={row[tie]}: no cut between them is reproducible")
                cuts[place] = Cut(key, row[tie])
    return cuts
