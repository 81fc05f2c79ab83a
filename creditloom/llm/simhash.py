"""SimHash near-duplicates: fingerprints, and an exact Hamming join by the generalised pigeonhole principle.

The 64 bits are cut into m partitions with thresholds t_1..t_m. If the thresholds sum up to
``radius - m + 1``, two fingerprints within ``radius`` bits agree, in at least one partition i, up to t_i
bits; a threshold of -1 leaves the partition out. So it suffices to look up, in each partition, all values
within t_i bits of one's own, and to verify what is found. Bits that go together are put into the same
partition, and thresholds are chosen by dynamic programming on the number of candidates they let through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..scratch import materialise
from .links import components

SEED = 42
BITS = 64
BLOCK = 8
#: Cost of one probe (a row that is shuffled and sorted), in verified candidates.
PROBE_COST = 8.0
#: Hashes whose bits are counted at once.
_AT_ONCE = 1 << 15


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Majority bits over the XXH64 of all shingles of ``size`` words; 0 without words."""
    words = (text or b"").lower().split()  # bytes: only A-Z and the six ASCII blanks count
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    count = max(1, len(words) - size + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=count)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, count, _AT_ONCE):
        octets = hashes[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fingerprint bigint, the columns ``also``) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = pa.array((fingerprint(t.as_py(), size) for t in texts), type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values, *batch.columns[2:]], names=["doc_id", "fingerprint", *also])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fingerprint", T.LongType()), *[docs.schema[c] for c in also]])
    return docs.select("doc_id", "text", *also).mapInArrow(run, schema)


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[tuple[int, int]]:
        """(bits to flip, highest of them) for every change of up to ``threshold`` bits."""
        found = [(0, 0)]
        for n in range(1, self.threshold + 1):
            found += [(_signed(sum(1 << b for b in c)), _signed(1 << max(c))) for c in combinations(self.bits, n)]
        return found


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _statistics(fps: DataFrame, order: list[int] | None) -> np.ndarray:
    """Counts over all fingerprints: of two bits set together, or (with ``order``) of the values of each block of eight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS) if order is None else (BITS // BLOCK, 1 << BLOCK), dtype=np.int64)
        for batch in batches:
            octets = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(octets, axis=1, bitorder="little")
            if order is None:
                wide = bits.astype(np.float32)
                total += (wide.T @ wide).astype(np.int64)
            else:
                values = np.packbits(bits[:, order], axis=1, bitorder="little")
                for k in range(BITS // BLOCK):
                    total[k] += np.bincount(values[:, k], minlength=1 << BLOCK)
        yield pa.RecordBatch.from_pydict({"row": list(range(len(total))), "counts": total.tolist()})

    rows = (
        fps.select("fingerprint").mapInArrow(run, "row bigint, counts array<bigint>")
        .select("row", F.posexplode("counts").alias("col", "n"))
        .groupBy("row", "col").agg(F.sum("n").alias("n"))
        .collect()  # at most 64 x 64 numbers
    )
    shape = (BITS, BITS) if order is None else (BITS // BLOCK, 1 << BLOCK)
    result = np.zeros(shape)
    for r in rows:
        result[r["row"], r["col"]] = r["n"]
    return result


def correlated_order(together: np.ndarray, total: int) -> list[int]:
    """The bits in an order whose runs of eight hold bits that correlate most."""
    share = together / max(total, 1)
    one = np.diag(share)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    tie = np.abs((share - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, order = set(range(BITS)), []
    while left:
        block = [max(left, key=lambda b: (sum(tie[b, o] for o in left), -b))]
        left.remove(block[0])
        while len(block) < BLOCK:
            block.append(max(left, key=lambda b: (sum(tie[b, o] for o in block), -b)))
            left.remove(block[-1])
        order += block
    return order


def _distances(counts: np.ndarray, radius: int) -> np.ndarray:
    """P(two fingerprints differ in exactly d bits of a block), d up to ``radius``, over all pairs of all rows."""
    p = counts / max(counts.sum(), 1)
    values = np.arange(1 << BLOCK)
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    weights = np.outer(p, p)
    return np.array([weights[apart == d].sum() for d in range(radius + 1)])


def layout(fps: DataFrame, radius: int) -> list[Partition]:
    """Partitions and thresholds with the least estimated cost, from counts over all of ``fps``.

    Within a block of eight correlated bits distances are exact, between blocks they are convolved. The
    number of partitions is tried from 1 to 8; for each, thresholds are allocated by dynamic programming.
    Any result is exact; statistics only decide its cost.
    """
    together = _statistics(fps, None)
    total = max(fps.count(), 1)
    order = correlated_order(together, total)
    near = [_distances(c, radius) for c in _statistics(fps, order)]
    blocks = len(near)
    best: tuple[float, list[Partition]] = (float("inf"), [])
    for m in range(1, blocks + 1):
        parts, start = [], 0
        for i in range(m):
            end = start + blocks // m + (i < blocks % m)
            chance = np.array([1.0])
            for k in range(start, end):
                chance = np.convolve(chance, near[k])[: radius + 1]
            parts.append((tuple(order[start * BLOCK : end * BLOCK]), np.cumsum(chance)))
            start = end
        # table: sum of thresholds so far -> (cost, thresholds)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits, chance in parts:
            following: dict[int, tuple[float, tuple[int, ...]]] = {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, radius + 1):
                    probes = _probes(len(bits), t)
                    price = 0.0 if t < 0 else total * probes * PROBE_COST + total * (total - 1) / 2 * float(chance[t])
                    option = (cost + price, (*chosen, t))
                    if option < following.get(spent + t, (float("inf"), ())):
                        following[spent + t] = option
            table = following
        if (radius - m + 1) in table:
            cost, chosen = table[radius - m + 1]
            if cost < best[0]:
                best = (cost, [Partition(bits, t) for (bits, _), t in zip(parts, chosen) if t >= 0])
    return best[1]


def _probes(width: int, threshold: int) -> float:
    """Mean number of probes of a row: one, and half of the changes (those whose highest bit is set)."""
    n, combos = 1.0, 1.0
    for t in range(1, threshold + 1):
        combos = combos * (width - t + 1) / t
        n += combos / 2
    return n


def hamming_links(fps: DataFrame, radius: int, parts: list[Partition]) -> DataFrame:
    """(a, b) of distinct ``fps`` (fingerprint) at up to ``radius`` differing bits; a pair may occur more than once.

    A pair whose values in a partition differ is looked up only from the side on which the highest
    differing bit is set, so each partition finds it once. Verification is part of the join condition.
    Keys shared by very many fingerprints are split by adaptive execution.
    """
    value = F.col("fingerprint")
    base = F.array(*[F.struct(F.lit(i).alias("part"), value.bitwiseAND(F.lit(p.mask)).alias("key")) for i, p in enumerate(parts)])
    probes = F.concat(*[_probe(value, i, p) for i, p in enumerate(parts)])
    left = fps.select(value.alias("a"), F.explode(probes).alias("p")).select("a", "p.part", "p.key", "p.same")
    right = fps.select(value.alias("b"), F.explode(base).alias("p")).select("b", "p.part", "p.key")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    once = ~F.col("same") | (F.col("a") < F.col("b"))
    same_key = (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key"))
    return left.alias("l").join(right.alias("r"), same_key & close & once).select("a", "b")


def _probe(value: Column, number: int, part: Partition) -> Column:
    own = value.bitwiseAND(F.lit(part.mask))
    flips = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(h).alias("h")) for m, h in part.flips()])
    due = F.filter(flips, lambda f: value.bitwiseAND(f["h"]) == f["h"])
    return F.transform(
        due,
        lambda f: F.struct(F.lit(number).alias("part"), own.bitwiseXOR(f["m"]).alias("key"), (f["m"] == 0).alias("same")),
    )


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint bigint, component_id) of every row of ``docs`` (doc_id, text, any other columns).

    component_id is the smallest doc_id reachable over links of up to ``radius`` differing bits. Null and
    empty texts have fingerprint 0 and are linked like any other. Equal fingerprints are one node, so a
    group of copies is never paired; rows that repeat come back as often as they came. A null doc_id is
    kept and is never a component_id unless the component has no other. An empty table gives an empty one.
    """
    fps = materialise(fingerprints(docs, size))
    nodes = materialise(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    grouped = _with_roots(nodes, radius)
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialise(grouped.join(least, "root").select("fingerprint", "component_id"))
    return fps.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _with_roots(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` (fingerprint, ...; each once) with the ``root`` of their component."""
    links = hamming_links(nodes.select("fingerprint"), radius, layout(nodes, radius))
    roots = materialise(components(links))
    found = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    return found.withColumn("root", F.coalesce("root", "fingerprint"))


def first_of_each(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns: that with the smallest doc_id.

    Rows without doc_id come last; rows of one doc_id are ordered by a digest of their text, so rows of unlike texts
    that share an id are told apart, and of equal rows one stays. Components are kept by row, never by id alone.
    """
    key = "__text_key"
    keyed = docs.select("doc_id", "text", F.coalesce(F.md5("text"), F.lit("")).alias(key))
    fps = materialise(fingerprints(keyed, size, [key]))
    rows = fps.groupBy("fingerprint", "doc_id", key).agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", key, "n"))
    nodes = materialise(rows.groupBy("fingerprint").agg(first.alias("first")))
    chosen = _with_roots(nodes, radius).groupBy("root").agg(F.min("first").alias("first"))
    chosen = materialise(chosen.select(F.col("first.doc_id").alias("__id"), F.col(f"first.{key}").alias("__key"), F.col("first.n").alias("__n")))
    same = docs["doc_id"].eqNullSafe(chosen["__id"]) & (F.coalesce(F.md5(docs["text"]), F.lit("")) == chosen["__key"])
    # Both sides are shuffled at every size: the chosen rows grow with the documents, so they are never broadcast.
    once = docs.join(chosen.filter("__n = 1").hint("merge"), same, "left_semi")
    repeated = docs.join(chosen.filter("__n > 1").hint("merge"), same, "left_semi")
    row = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__first_row")
    least = repeated.groupBy("doc_id", F.md5("text")).agg(row)
    return once.unionByName(least.select(*[F.col("__first_row")[c].alias(c) for c in docs.columns]))
