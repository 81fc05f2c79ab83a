"""Shards of equal row counts in which linked documents stay together, by balanced label propagation.

The label of a document is its shard. Documents of one link group all see the same neighbours, so the state is
one row per group with its row count on each shard: a group that holds a third of all rows is one row. In each
round a group's rows want to move to the shard where most of their neighbours are. What moves between two
shards is limited by what moves back, and by the room that the other rows leave; rows without links fill
the shards up at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import materialise
from .numbering import numbered

#: Rounds of propagation at most; it ends before when two rounds in a row move nothing.
ROUNDS = 12
_SLICES = 64


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _order(shard: int) -> Column:
    """Place of a shard in the preference of a group: rows there, ties by a hash of group and shard."""
    return F.struct(F.col("counts")[shard].alias("n"), F.xxhash64("group", F.lit(shard)).alias("tie"), F.lit(shard).alias("shard"))


def quotas(wanted: list[list[int]], room: list[int]) -> list[list[int]]:
    """Rows that may move from s to t: as many as want to move back, and what the room of t takes beyond."""
    n = len(room)
    allowed = [[min(wanted[s][t], wanted[t][s]) if s != t else 0 for t in range(n)] for s in range(n)]
    for t in range(n):
        left = max(0, room[t])
        for s in sorted(range(n), key=lambda s: allowed[s][t] - wanted[s][t]):
            more = min(left, wanted[s][t] - allowed[s][t])
            allowed[s][t] += more
            left -= more
    return allowed


def _propagate(state: DataFrame, shards: int, capacity: list[int]) -> DataFrame:
    """Rounds over (group, counts); the sums of counts over all groups stay within ``capacity``."""
    idle, only_room = 0, False
    for _ in range(ROUNDS):
        used = state.agg(*[F.coalesce(F.sum(F.col("counts")[s]), F.lit(0)) for s in range(shards)]).first()
        room = [c - int(u) for c, u in zip(capacity, used)]
        targets = [s for s in range(shards) if not only_room or room[s] > 0] or list(range(shards))
        only_room = not only_room
        best = F.greatest(*[_order(s) for s in targets]) if len(targets) > 1 else _order(targets[0])
        aimed = state.withColumn("best", best)
        # Rows on shards that stand lower in the group's order want to move; that never cuts more links.
        wishes = F.filter(
            F.array(*[F.struct(F.lit(s).alias("source"), F.col("counts")[s].alias("n"), _order(s).alias("at")) for s in range(shards)]),
            lambda w: (w["n"] > 0) & (w["at"] < F.col("best")),
        )
        moves = materialise(
            aimed.select("group", F.col("best.shard").alias("target"), F.col("best.n").alias("there"), F.explode(wishes).alias("w"))
            .select("group", "target", F.col("w.source").alias("source"), F.col("w.n").alias("n"),
                    F.floor(F.log2(F.col("there") + 1)).alias("level"), F.pmod(F.xxhash64("group"), F.lit(_SLICES)).alias("slice"))
        )
        wanted = [[0] * shards for _ in range(shards)]
        for r in moves.groupBy("source", "target").agg(F.sum("n").alias("n")).collect():  # shards x shards rows
            wanted[r["source"]][r["target"]] = int(r["n"])
        allowed = quotas(wanted, room)
        if not any(map(sum, allowed)):
            idle += 1
            if idle == 2:
                break
            continue
        idle = 0
        # Running sums per pair of shards, large neighbourhoods first: over slices, then inside a slice.
        part = ["source", "target", "level", "slice"]
        earlier = Window.partitionBy("source", "target").orderBy(F.desc("level"), "slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = moves.groupBy(*part).agg(F.sum("n").alias("all"))
        starts = slices.select(*part, F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("start"))
        inside = Window.partitionBy(*part).orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
        quota = F.array(*[F.lit(q) for row in allowed for q in row])[F.col("source") * shards + F.col("target")]
        taken = moves.withColumn("upto", F.sum("n").over(inside)).join(starts, part)
        taken = taken.withColumn("moved", F.least(F.col("n"), F.greatest(F.lit(0), quota - F.col("start") - F.col("upto") + F.col("n"))))
        change = taken.filter("moved > 0").groupBy("group").agg(
            F.first("target").alias("target"),
            F.array(*[F.sum(F.when(F.col("source") == s, F.col("moved")).otherwise(0)) for s in range(shards)]).alias("out"),
        )
        joined = state.join(change, "group", "left")
        out = [F.coalesce(F.col("out")[s], F.lit(0)) for s in range(shards)]
        counts = [
            F.col("counts")[s] - out[s] + F.when(F.col("target") == s, sum(out[1:], out[0])).otherwise(0) for s in range(shards)
        ]
        state = materialise(joined.select("group", F.array(*counts).alias("counts")))
    return state


def _shard_of(rank: Column, counts: list[Column]) -> Column:
    """Number of the interval that holds ``rank`` when the counts are laid end to end."""
    reached, upto = F.lit(0), F.lit(0)
    for c in counts[:-1]:
        upto = upto + c
        reached = reached + (rank >= upto).cast("int")
    return reached


def balanced_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, link_group, linked_rows, shard, slot) of every row of ``docs`` (doc_id, text, other columns).

    Law: the row counts of any two shards differ by one at most. Links are equal texts; null texts count as
    empty ones. size: UTF-8 bytes of the text plus 1. slot: gapless from 0 within the shard. A group larger than
    a shard fills shards in turn. Rows that repeat are rows of their own; rows without doc_id are placed as
    well. An empty table gives an empty one. Only counts per shard, or pair of shards, reach the driver.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialise(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
                    F.xxhash64(text, F.octet_length(text)).alias("group"))
    )
    total = rows.count()
    capacity = capacities(total, shards)
    start = numbered(rows, "rank", ["doc_id", "group"], rows=total).withColumn("label", F.pmod("rank", F.lit(shards)))
    per_shard = [F.sum((F.col("label") == s).cast("bigint")) for s in range(shards)]
    groups = materialise(start.groupBy("group").agg(F.count("*").alias("n"), F.array(*per_shard).alias("counts")))
    final = _propagate(materialise(groups.filter("n > 1").select("group", "counts")), shards, capacity)
    used = [int(u) for u in final.agg(*[F.coalesce(F.sum(F.col("counts")[s]), F.lit(0)) for s in range(shards)]).first()]

    # One join tells linked rows and their group's counts; hot groups are split by adaptive execution.
    known = materialise(rows.join(final, "group", "left").withColumn("n", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)))
    linked = numbered(known.filter("n is not null"), "rank", ["doc_id"], by=["group"], rows=F.col("n"))
    linked = linked.withColumn("shard", _shard_of(F.col("rank"), [F.col("counts")[s] for s in range(shards)]))
    alone = numbered(known.filter("n is null"), "rank", ["doc_id", "group"])
    alone = alone.withColumn("shard", _shard_of(F.col("rank"), [F.lit(c - u) for c, u in zip(capacity, used)]))
    kept = ["doc_id", "size", "text_crc32", "group", "n", "shard"]
    placed = materialise(linked.select(*kept).unionByName(alone.select(*kept)))
    slots = numbered(placed, "slot", ["doc_id", "group"], by=["shard"], rows=total // shards + 1)
    return slots.select(
        "doc_id", "size", "text_crc32", F.col("group").alias("link_group"), F.coalesce("n", F.lit(1)).alias("linked_rows"), "shard", "slot"
    )
