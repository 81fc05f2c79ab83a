"""Prefix trie of conversations: one row per distinct sequence of first turns, with sums over what continues it.

A prefix is named by a digest of 128 bits, the XOR of digests of its turns with their places, so a running XOR gives
the digests of all prefixes, and that of the parent is the same without the last turn. Distinct prefixes are enumerated by
a grouping, which also checks that no two of them share a digest.

Every node belongs to its conversation with the smallest id, so the nodes of a conversation are the end of its path, and
a node's sum over its subtree is the sum over conversations of what they own from that node on. Paths are dealt into
shards. A shard gives the digests of its paths slots of a minimal perfect hash, verifies them, scatters what is owned
into flat arrays, and hands it on to the parents' slots from the deepest node to the root. Sums of a node from several
shards are added by a grouping. Long paths are cut into pieces; what is owned further on is carried into a piece's last slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import materialise
from .hot import join_counted

#: Turns of a path that stay together.
PIECE = 1024
#: Turns of a shard, more only to complete a piece.
SHARD_ROWS = 100_000
#: Ids of a node's list of ends that are joined at once.
LISTED = 4096
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of every row of ``turns`` (conv_id, turn, role, text, any other columns); place counts from 0.

    Rows are ordered by turn (null first), ties by role and text; null roles and texts become empty. Rows without
    conv_id belong to no conversation and are left out. Rows are sorted over range partitions, so a conversation with a large part of
    all rows is spread: within each partition rows are counted from the rows of earlier ones.
    """
    filled = turns.filter("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    # Long texts need not go to the sample of range bounds.
    ranged = materialise(filled.repartitionByRange(*order, F.left("text", F.lit(64))).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("conv_id", "part").orderBy(*order[1:], "text")
    per = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    # Only conversations across a bound have several parts: fewer than two rows for each partition.
    split = per.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).filter(F.size("parts") > 1)
    earlier = F.expr("transform(parts, (p, i) -> struct(p.part as part, aggregate(slice(parts, 1, i), 0L, (total, q) -> total + q.n) as start))")
    starts = materialise(split.select("conv_id", F.explode(earlier).alias("s")).select("conv_id", "s.*"))
    numbered = ranged.withColumn("place", F.row_number().over(inside) - 1).join(starts.hint("broadcast"), ["conv_id", "part"], "left")
    return numbered.select("conv_id", (F.col("place") + F.coalesce("start", F.lit(0))).alias("place"), "role", "text")


def _prefixes(numbered: DataFrame) -> DataFrame:
    """(conv_id, depth, piece, x, y, px, py, said, bytes) of all prefixes: their digest, that of their parent, a digest of the last turn."""
    depth = F.col("place") + 1

    def digest(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), depth, "role", F.length("role"), "text", F.lit(~salt))

    turns = numbered.select(
        "conv_id", depth.alias("depth"), F.floor(F.col("place") / PIECE).alias("piece"), digest(1).alias("hx"), digest(2).alias("hy"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("said"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )
    turns = materialise(turns)
    per = turns.groupBy("conv_id", "piece").agg(*[F.bit_xor(f"h{c}").alias(f"h{c}") for c in "xy"])
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of more than one piece carry digests on.
    carried = per.select("conv_id", "piece", *[F.bit_xor(f"h{c}").over(before).alias(f"c{c}") for c in "xy"]).filter("piece > 0")
    running = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = turns.select("*", *[F.bit_xor(f"h{c}").over(running).alias(f"r{c}") for c in "xy"])
    first, later = own.filter("piece = 0"), own.filter("piece > 0")
    carried_on = later.join(carried.hint("merge"), ["conv_id", "piece"])
    both = first.withColumns({"cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint")}).unionByName(carried_on)
    digests = {c: F.col(f"r{c}").bitwiseXOR(F.col(f"c{c}")) for c in "xy"}
    return both.select(
        "conv_id", "depth", "piece", digests["x"].alias("x"), digests["y"].alias("y"),
        digests["x"].bitwiseXOR(F.col("hx")).alias("px"), digests["y"].bitwiseXOR(F.col("hy")).alias("py"), "said", "bytes",
    )


def _hashed(x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
    z = x + y * _GOLDEN + np.uint64((level * 0xD1B54A32D192ED03) % (1 << 64))
    z = (z ^ z >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ z >> np.uint64(29)


class Slots:
    """Minimal perfect hash of distinct keys (x, y): each key takes a place of the first level where it is alone."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = len(x)
        taken, ax, ay = 0, x, y
        while len(ax):
            at = (_hashed(ax, ay, len(self.levels)) % np.uint64(2 * len(ax))).astype(np.int64)
            alone = np.bincount(at, minlength=2 * len(ax)) == 1
            self.levels.append((alone, taken + np.cumsum(alone) - 1))
            taken += int(alone.sum())
            ax, ay = ax[~alone[at]], ay[~alone[at]]
        # Keys by slot, against which every look-up is verified.
        self.x, self.y = np.zeros(len(x), dtype=np.uint64), np.zeros(len(x), dtype=np.uint64)
        slot = self._find(x, y)
        self.x[slot], self.y[slot] = x, y
        if not ((self.x[slot] == x) & (self.y[slot] == y)).all():
            raise ValueError("keys of a node table must be distinct")

    def _find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        found = np.zeros(len(x), dtype=np.int64)
        left = np.arange(len(x))
        for level, (alone, slots) in enumerate(self.levels):
            at = (_hashed(x[left], y[left], level) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            found[left[hit]] = slots[at[hit]]
            left = left[~hit]
        return found

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those that are not in the table."""
        if not self.size:
            return np.full(len(x), -1, dtype=np.int64)
        slot = self._find(x, y)
        return np.where((self.x[slot] == x) & (self.y[slot] == y), slot, -1)


def subtree_sums(depth: np.ndarray, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, saved: np.ndarray, leaves: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, ...]:
    """(x, y, saved, leaves) of all nodes on some pieces of paths, and of the root where one begins, summed over what is owned below them.

    A node that is not ``linked`` is the first of a piece: what it owns has been carried into the piece before.
    """
    root = np.flatnonzero(depth == 1)[:1]
    keys = np.unique(np.stack([np.append(x, px[root]), np.append(y, py[root])], axis=1), axis=0)
    slots = Slots(keys[:, 0], keys[:, 1])
    slot, above = slots.of(x, y), np.where(linked, slots.of(px, py), -1)
    parent, level = np.full(slots.size, -1, dtype=np.int64), np.zeros(slots.size, dtype=np.int64)
    parent[slot], level[slot] = above, depth
    sums = []
    by_depth = np.argsort(-level, kind="stable")
    bounds = np.flatnonzero(np.diff(level[by_depth])) + 1
    for owned in (saved, leaves):
        total = np.zeros(slots.size, dtype=np.int64)
        np.add.at(total, slot, owned)
        for nodes in np.split(by_depth, bounds):
            nodes = nodes[parent[nodes] >= 0]
            np.add.at(total, parent[nodes], total[nodes])
        sums.append(total)
    return slots.x, slots.y, *sums


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the shards of a task: rows come sorted by conversation and piece."""
    held: list[pa.RecordBatch] = []

    def result(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(c).to_numpy() for c in ("depth", "x", "y", "px", "py", "saved", "leaves", "linked")]
        signed = [c.view(np.uint64) if 1 <= i <= 4 else c for i, c in enumerate(columns)]
        x, y, saved, leaves = subtree_sums(*signed)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (x.view(np.int64), y.view(np.int64), saved, leaves)], names=["x", "y", "saved", "leaves"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SHARD_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            piece = np.stack([table.column("conv_id").to_numpy(), table.column("piece").to_numpy()])
            starts = np.flatnonzero((piece[:, 1:] != piece[:, :-1]).any(axis=0)) + 1
            if not len(starts):
                continue
            yield result(table.slice(0, int(starts[-1])))
            held = table.slice(int(starts[-1])).to_batches()
    if held and sum(b.num_rows for b in held):
        yield result(pa.Table.from_batches(held).combine_chunks())


def _ends(ends: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of nodes where conversations end: the ids of ``ends`` (x, y, conv_id), ascending, joined by commas.

    Ids are sorted over range partitions and joined in strings of LISTED ids; a digest reads the strings of its node in order.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        names = ["x", "y", "first", "ids"]

        def piece() -> tuple:
            return (*key, ids[0], ",".join(map(str, ids)))

        for batch in batches:
            rows = []
            for x, y, c in zip(*(col.to_pylist() for col in batch.columns)):
                if key != (x, y) or len(ids) == LISTED:
                    if ids:
                        rows.append(piece())
                    key, ids = (x, y), []
                ids.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(piece(), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=names)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = []
            for x, y, _, ids in zip(*(col.to_pylist() for col in batch.columns)):
                if key == (x, y):
                    state.update(b",")
                else:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = (x, y), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.string()))], names=["x", "y", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=["x", "y", "ends_sha256"])

    ordered = ends.select("x", "y", F.col("conv_id").cast("bigint")).repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id")
    strings = ordered.mapInArrow(joined, "x bigint, y bigint, first bigint, ids string")
    return strings.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(digested, "x bigint, y bigint, ends_sha256 string")


def prefix_nodes(numbered: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``numbered`` (conv_id, place, role, text; as of ``numbered_turns``) and ``conversations`` (conv_id).

    A node is a distinct sequence of first turns; the root, at depth 0, has none. Its members are the conversations that start
    with it; conversations without turns are members of the root. Returned are (conv_id, smallest member; depth; parent_conv_id,
    that of the parent, null for the root; n_convs; n_children; n_leaves, childless nodes of the subtree, itself included; saved_tokens,
    (n_convs - 1) times the bytes of the last text, summed over the subtree; ends_sha256 of the ids of conversations that end
    here, ascending and joined by commas). Ids that are null are left out; without conversations there is no node. A whole
    conversation of very many turns is never one group: only digests and numbers of a piece meet.
    """
    prefixes = materialise(_prefixes(numbered))
    check = [f"{f}({c}) as {f}_{c}" for c in ("px", "py", "said", "depth", "bytes") for f in ("min", "max")]
    grouped = prefixes.groupBy("x", "y").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.expr(c) for c in check])
    checked = materialise(grouped)
    unlike = " or ".join(f"min_{c} <> max_{c}" for c in ("px", "py", "said", "depth", "bytes"))
    if not checked.filter(unlike).isEmpty():
        raise ValueError("two prefixes share a digest of 128 bits")
    nodes = checked.select("x", "y", "n_convs", "conv_id", *[F.col(f"min_{c}").alias(c) for c in ("px", "py", "depth", "bytes")])
    children = materialise(nodes.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children")))
    nodes = nodes.join(children.hint("merge"), ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialise(nodes)

    owned = nodes.select(
        "conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves")
    )
    paths = prefixes.select("conv_id", "depth", "piece", "x", "y", "px", "py").join(owned.select("conv_id").distinct().hint("merge"), "conv_id", "left_semi")
    paths = paths.join(owned.hint("merge"), ["conv_id", "depth"], "left").fillna(0, ["saved", "leaves"])
    paths = materialise(paths)
    per = paths.groupBy("conv_id", "piece").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.max("depth").alias("depth"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several pieces carry sums towards their start.
    carried = per.select("conv_id", "depth", *[F.sum(c).over(later).alias(f"more_{c}") for c in ("saved", "leaves")]).filter("more_leaves is not null")
    whole = paths.join(carried.hint("merge"), ["conv_id", "depth"], "left")
    whole = whole.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("saved", "leaves")}).drop("more_saved", "more_leaves")
    whole = whole.withColumn("linked", (F.col("depth") == 1) | ((F.col("depth") - 1) % PIECE != 0))
    dealt = whole.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece")
    sums = dealt.mapInArrow(_shards, "x bigint, y bigint, saved bigint, leaves bigint")
    sums = materialise(sums.groupBy("x", "y").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))

    zero = F.lit(0).cast("bigint")
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("x", "y"), "depth").alias("end"))
    everyone = materialise(conversations.select("conv_id").filter("conv_id is not null").distinct())
    ends = everyone.join(last.hint("merge"), "conv_id", "left").select("conv_id", F.coalesce("end.x", zero).alias("x"), F.coalesce("end.y", zero).alias("y"))
    ends = materialise(_ends(ends))

    top = everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = top.select(
        zero.alias("x"), zero.alias("y"), "n_convs", "conv_id", F.lit(None).cast("bigint").alias("px"), F.lit(None).cast("bigint").alias("py"), zero.alias("depth"), zero.alias("bytes")
    ).join(children.filter("x = 0 and y = 0"), ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    top = materialise(top)  # one row
    root = top.first()
    first_level = nodes.filter("depth = 1").withColumn("parent_conv_id", F.lit(root["conv_id"] if root else None).cast("bigint"))
    parents = nodes.filter("n_children > 0").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    deeper = join_counted(nodes.filter("depth > 1"), parents, ["px", "py"]).drop("n")
    everything = top.withColumn("parent_conv_id", F.lit(None).cast("bigint")).unionByName(first_level).unionByName(deeper)
    filled = everything.join(sums.hint("merge"), ["x", "y"], "left").join(ends.hint("merge"), ["x", "y"], "left")
    return filled.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
