import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import small
from pyspark.sql import functions as F

from creditloom.llm import hot, queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, x string, piece string, depth string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "x", "x") for r in rows], SCHEMA)


def brute(conversations):
    """Nodes of {conv_id: [(role, text), ...]}, each from its members."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    found = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        ends = sorted(c for c in own if len(conversations[c]) == len(path))
        found.append((
            min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children), len(leaves),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(found, key=small.key)


def ordered(rows):
    """{conv_id: [(role, text), ...]} of rows, in order."""
    found = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(c, []).append((role or "", text or ""))
    return found


def some_rows(generator, many=30):
    rows = []
    for c in range(many):
        turns = [(t, generator.choice(["user", "assistant", None]), generator.choice(["", "a", "é b", None])) for t in range(generator.randint(1, 7))]
        rows += [(c, t if generator.random() < 0.9 else None, role, text) for t, role, text in turns]
    return rows + [(None, 1, "user", "nobody's"), (3, 50, "user", "again"), (3, 50, "user", "again"), (90, None, None, None)]


def nodes(spark, rows):
    numbered = trie.numbered_turns(table(spark, rows))
    return small.rows(trie.prefix_nodes(numbered, table(spark, rows)).select(*NODE))


@pytest.mark.parametrize("piece", [2, 1024])
def test_nodes_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = some_rows(random.Random(piece))
    assert nodes(spark, rows) == brute(ordered(rows))


def test_hot_keys_and_turnless_conversations(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST_HOT", 2)
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, t, "user", "same" if t < 4 or c % 3 else f"own {c}") for c in range(40) for t in range(7)] + [(50, t, "user", "x") for t in range(200)]
    numbered = trie.numbered_turns(table(spark, rows))
    everyone = spark.range(45).select(F.col("id").alias("conv_id")).unionByName(table(spark, rows).select("conv_id"))
    got = small.rows(trie.prefix_nodes(numbered, everyone).select(*NODE))
    assert got == brute({**{c: [] for c in range(45)}, **ordered(rows)})


def test_places_across_range_partitions(spark):
    rows = [(c, t, "user", f"{t:04}") for c in (1, 2) for t in range(300)] + [(2, None, "user", "first")] * 3
    found = sorted((r["conv_id"], r["place"], r["text"]) for r in trie.numbered_turns(table(spark, rows)).collect())
    assert found == [(c, i, text) for c, turns in sorted(ordered(rows).items()) for i, (_, text) in enumerate(turns)]


def test_empty_tables(spark):
    assert nodes(spark, []) == []
    got = trie.prefix_nodes(trie.numbered_turns(table(spark, [])), spark.range(2).select(F.col("id").alias("conv_id")))
    assert small.rows(got.select(*NODE)) == [(0, 0, None, 2, 0, 1, 0, hashlib.sha256(b"0,1").hexdigest())]


def test_rebuilt_query_equals_brute_force(spark, tmp_path):
    rows = some_rows(random.Random(9), 41)
    table(spark, [r for r in rows if r[0] not in (10, 25)]).write.parquet(f"{tmp_path}/conversations.parquet")
    own = ordered([r for r in rows if r[0] not in (10, 25)])
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    assert small.rows(queries.op11_conversation_prefix_trie(spark, str(tmp_path)).select(*NODE)) == brute(rebuilt)


def test_slots_are_minimal_and_verified():
    generator = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        x, y = generator.integers(0, 1 << 20, n, dtype=np.uint64), generator.permutation(n).astype(np.uint64)
        slots = trie.Slots(x, y)
        assert sorted(slots.of(x, y).tolist()) == list(range(n))
        assert (slots.of(x + np.uint64(1 << 40), y) == -1).all()


def test_shards_end_between_pieces():
    rows = [(c, 0, d, 10 * c + d, 0, 10 * c + d - 1 if d > 1 else 0, 0, 1, int(d == 3), True) for c in range(1, 9) for d in (1, 2, 3)]
    names = ["conv_id", "piece", "depth", "x", "y", "px", "py", "saved", "leaves", "linked"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "linked" else pa.int64()) for n, c in zip(names, zip(*rows[i : i + 4]))], names=names) for i in range(0, len(rows), 4)]
    whole = trie.SHARD_ROWS
    try:
        trie.SHARD_ROWS = 7
        parts = list(trie._shards(iter(batches)))
    finally:
        trie.SHARD_ROWS = whole
    assert len(parts) > 2
    sums = {}
    for p in parts:
        for x, _, saved, leaves in zip(*(c.to_pylist() for c in p.columns)):
            sums[x] = tuple(a + b for a, b in zip(sums.get(x, (0, 0)), (saved, leaves)))
    assert sums[0] == (24, 8) and all(sums[10 * c + d] == (4 - d, 1) for c in range(1, 9) for d in (1, 2, 3))
