"""MinHash near-duplicates: groups of sets that share a band, compared in full inside the groups.

Each distinct set of shingles has a signature of COORDINATES minima, cut into bands of BAND coordinates. Two sets of
similarity s share a band with probability 1 - (1 - s**BAND)**BANDS: at s = 0.85 that loses one pair in 480 million, above
that fewer. Pairs that share a band are candidates, the others are let go. Bands of one set only drop out at once.

Of the sets with a band the one that shares most with others leads it, so the many bands of a family of near copies have few
leaders. The sets of all bands of a leader are its group: each candidate pair meets in a group, and a set is sent to
a group once, however many of its bands lead there. Nothing is made for each pair: the whole sets of a group meet in one task,
which counts what they share and returns links enough to span the components it sees.

Large groups are cut into blocks. First each block is compared by itself, with the leader and a few others as guests, which is work in
proportion to the group and joins most of what belongs together. Only groups that are then still of more than one component go on: all
their blocks meet each other, but not blocks of the largest component among themselves.
So the components are those of all candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..scratch import materialise
from .batches import pieces
from .hot import join_counted
from .links import components

SEED = 42
BAND, BANDS = 3, 21
COORDINATES = BAND * BANDS
#: Sets of up to USUAL shingles that meet in one task, half of them from either block; longer sets count as several.
GROUP_PAIRS = 2048
USUAL = 256
#: Share of GROUP_PAIRS up to which a group is compared at once, uncut.
PAIRS_EACH = 0.25
#: Sets that visit all blocks of a large group with its leader, on average.
GROWTH = 4
#: Hashes that meet all coordinates at once.
_AT_ONCE = 1 << 10

_RANDOM = np.random.default_rng(SEED)
_FIRST, _SECOND = (_RANDOM.integers(0, 1 << 63, size=(COORDINATES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


class _Hashes(dict):
    """XXH64 of words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: bytes | None, size: int = 3, words: _Hashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all shingles of ``size`` words; fewer words are one shingle, no words none."""
    found = (text or b"").lower().split()  # bytes: only A-Z and the six ASCII blanks count
    if not found:
        return np.zeros(0, dtype=np.uint64)
    words = _Hashes() if words is None else words
    hashed = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(size, len(found))
    total = np.full(len(found) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = _mixed(total + hashed[k : k + len(total)])
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minimum of the hashes under each coordinate's own order."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _AT_ONCE):
        x = hashes[at : at + _AT_ONCE] * _FIRST
        x ^= x >> np.uint64(29)
        x *= _SECOND
        least = np.minimum(least, x.min(axis=1))
    return least.view(np.int64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the signature of ``hashes``; equal keys of unlike bands do not occur but by accident."""
    parts = signature(hashes).view(np.uint64).reshape(BANDS, BAND)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND):
        keys = _mixed(keys + parts[:, k])
    return keys.view(np.int64)


def _marked(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, content, n_shingles, bands) of every row; content is a digest of the set, empty for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            words = _Hashes()
            sets = [shingles(t.as_py(), size, words) for t in batch.column(1).cast(pa.binary())]
            columns = [
                batch.column(0), batch.column(2), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"" for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "content", "n_shingles", "bands"])

    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.BinaryType()), T.StructField("content", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])
    return docs.select("doc_id", "text", _text_key().alias("text_key")).mapInArrow(run, schema)


def _text_key():
    """Digest of the text, then of the id: copies under other ids have other keys, so a text with many copies is fetched once."""
    return F.unhex(F.concat(F.md5("text"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of ``nodes`` (node, text_key), from ``docs``."""
    found = docs.select("text", _text_key().alias("text_key")).join(nodes.hint("merge"), "text_key")
    # Rows that repeat have equal keys; one of them is enough.
    return found.groupBy("text_key", "node").agg(F.min("text").alias("text")).select("node", "text")


def _members(nodes: DataFrame) -> DataFrame:
    """(group, node, units) of the sets that share a band with others: a group is named by its leader."""
    posts = nodes.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = join_counted(posts, materialise(posts.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")), ["band"])
    by_node = shared.groupBy("node", "n_shingles").agg(F.sum("n").alias("weight"), F.collect_list("band").alias("bands"))
    units = F.greatest(F.lit(1.0), F.col("n_shingles") / USUAL)
    posts = materialise(by_node.select("node", "weight", units.alias("units"), F.explode("bands").alias("band")))
    leaders = posts.groupBy("band").agg(F.max(F.struct("weight", "node"))["node"].alias("group"), F.count("*").alias("n"))
    return join_counted(posts, materialise(leaders), ["band"]).select("group", "node", "units").distinct()


def _dealt(node: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.greatest(F.lit(1), F.ceil(blocks)).cast("int")).cast("int")


def _span(held: list[tuple[int, int, np.ndarray]], apart: bool, share: Fraction) -> Iterator[tuple[int, int]]:
    """Links of unlike roots that span the components of ``held`` (root, side, set), all sets or, if ``apart``, those of unlike sides."""
    held = sorted(held, key=lambda h: len(h[2]))
    roots, sides = (np.array([h[k] for h in held], dtype=np.int64) for k in (0, 1))
    sizes = np.array([len(h[2]) for h in held])
    # The hashes that occur in several sets are numbered; a set is a row of bits.
    _, which, times = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True, return_counts=True)
    often = times > 1
    kept = often[which]
    place, owner = (np.cumsum(often) - 1)[which[kept]], np.repeat(np.arange(len(held)), sizes)[kept]
    bits = np.zeros((len(held), int(often.sum()) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    label = np.unique(roots, return_inverse=True)[1]
    upto = np.searchsorted(sizes * share.numerator, sizes * share.denominator, "right")
    for i in range(len(held)):
        others = slice(i + 1, upto[i])
        j = i + 1 + np.flatnonzero((label[others] != label[i]) & ((sides[others] != sides[i]) | (not apart)))
        if not len(j):
            continue
        common = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
        alike = j[common * share.denominator >= (sizes[j] + sizes[i] - common) * share.numerator]
        first = np.unique(label[alike], return_index=True)[1]
        for k in alike[first]:
            yield int(roots[i]), int(roots[k])
        label[np.isin(label, label[alike])] = label[i]


def _links(tasks: DataFrame, texts: DataFrame, size: int, share: Fraction) -> DataFrame:
    """(a, b): roots to be joined, from ``tasks`` (group, i, j, node, root, side); each (group, i, j) is compared in one task.

    Where i and j are unlike, sets of unlike sides are compared only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def found() -> list[tuple[int, int]]:
            return list(_span(held, current[1] != current[2], share)) if len({h[0] for h in held}) > 1 else []

        def written(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in pieces(batches, 0):
            words, links = _Hashes(), []
            texts_here, *keys, roots, sides = (batch.column(k) for k in range(6))
            for text, key, root, side in zip(texts_here.cast(pa.binary()), zip(*(k.to_pylist() for k in keys)), roots.to_pylist(), sides.to_pylist()):
                if key != current:
                    links += found()
                    current, held = key, []
                held.append((root, side, shingles(text.as_py(), size, words)))
            yield written(links)
        yield written(found())

    keys = ["group", "i", "j"]
    sent = tasks.join(texts.hint("merge"), "node").repartition(*keys).sortWithinPartitions(*keys)
    return sent.select("text", *keys, "root", "side").mapInArrow(run, "a bigint, b bigint").distinct()


def _first_tasks(members: DataFrame, groups: DataFrame) -> DataFrame:
    """All sets of small groups; the blocks of large ones, each by itself with the leader and about GROWTH others."""
    met = join_counted(members, groups, ["group"])
    blocks = F.when(F.col("large"), F.greatest(F.lit(1), F.ceil(2 * F.col("all_units") / GROUP_PAIRS))).otherwise(1).cast("int")
    place = F.pmod(F.xxhash64("node", F.lit("guest")), F.lit(1 << 30)) / float(1 << 30)
    guest = (F.col("node") == F.col("group")) | (place < F.lit(GROWTH) / F.col("n"))
    own = F.when(guest, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(_dealt("node", blocks)))
    each = met.select("group", "node", F.explode(own).alias("i"))
    return each.select("group", "i", F.col("i").alias("j"), "node", F.col("node").alias("root"), F.lit(0).alias("side"))


def _second_tasks(members: DataFrame, groups: DataFrame, placed: DataFrame) -> DataFrame:
    """Blocks of large groups of several components, each with each, but not those of the component with most units among themselves."""
    large = groups.filter("large").select("group", "n")
    held = join_counted(members, materialise(large), ["group"]).drop("n").join(placed.hint("merge"), "node", "left")
    held = materialise(held.withColumn("root", F.coalesce("root", "node")))
    by_root = held.groupBy("group", "root").agg(F.sum("units").alias("units"), F.count("*").alias("n"))
    most = F.max(F.struct("units", "root"))
    split = by_root.groupBy("group").agg(most["root"].alias("main"), most["units"].alias("main_units"), F.sum("units").alias("all_units"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    met = join_counted(held, materialise(split.filter("roots > 1")), ["group"])
    cut = {"main": F.col("main_units"), "rest": F.col("all_units") - F.col("main_units")}
    cut = {k: F.greatest(F.lit(1), F.ceil(2 * v / GROUP_PAIRS)).cast("int") for k, v in cut.items()}
    in_main = F.col("root") == F.col("main")
    block = F.when(in_main, cut["rest"] + _dealt("node", cut["main"])).otherwise(_dealt("node", cut["rest"]))
    others = F.sequence(F.lit(0), F.when(in_main, cut["rest"]).otherwise(cut["rest"] + cut["main"]) - 1)
    each = met.select("group", "node", "root", block.alias("side"), others.alias("others")).withColumn("other", F.explode("others"))
    return each.select("group", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "root", "side")


def _joined_roots(members: DataFrame, texts: DataFrame, size: int, share: Fraction) -> DataFrame:
    """(node, root) of all sets that are linked with others, by the components of the links inside all groups."""
    groups = members.groupBy("group").agg(F.sum("units").alias("all_units"), F.count("*").alias("n"))
    groups = materialise(groups.withColumn("large", F.col("all_units") > PAIRS_EACH * GROUP_PAIRS))
    placed = materialise(components(materialise(_links(_first_tasks(members, groups), texts, size, share))))
    if groups.filter("large").isEmpty():
        return placed
    more = materialise(_links(_second_tasks(members, groups, placed), texts, size, share))
    if more.isEmpty():
        return placed
    moved = components(more).select(F.col("node").alias("old"), F.col("root").alias("new"))
    # A set without links so far is its own root and comes in here.
    either = placed.join(moved.hint("merge"), F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return materialise(either.unionByName(moved.join(placed.hint("merge"), F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))))


def near_duplicates(docs: DataFrame, size: int = 3, similarity: float = 0.85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text, any other columns).

    Two texts are linked if the sets of their shingles of ``size`` words have a Jaccard similarity of ``similarity``
    or more; component_id is the smallest doc_id reachable over links. A set is that of the 64-bit hashes of the shingles.
    Null texts and texts without words have the empty set, are linked with nothing, and have their own doc_id as
    component_id. Equal sets are one node; rows that repeat come back as often as they came. A null doc_id is kept and
    is never a component_id unless the component has no other. An empty table gives an empty one.
    """
    share = Fraction(str(similarity))
    marked = materialise(_marked(docs, size))
    per_set = marked.filter("n_shingles > 0").groupBy("content").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"),
        F.min("text_key").alias("text_key"), F.first("bands").alias("bands"),
    )
    nodes = materialise(per_set.withColumn("node", F.monotonically_increasing_id()))
    members = materialise(_members(nodes))
    meeting = nodes.select("node", "text_key").join(members.select("node").distinct().hint("merge"), "node")
    roots = _joined_roots(members, materialise(_texts(docs, meeting)), size, share)
    grouped = nodes.select("content", "node", "first_id", "n").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_nodes"))
    joined = join_counted(grouped.select("content", "root", "n"), materialise(least), ["root"], "n_nodes")
    classes = materialise(joined.select("content", "component_id", "n"))
    filled = join_counted(marked.filter("n_shingles > 0").select("doc_id", "content", "n_shingles"), classes, ["content"])
    empty = marked.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.select("doc_id", "n_shingles", "component_id").unionByName(empty)
