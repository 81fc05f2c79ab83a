import random

import numpy as np
import pytest
import small

from creditloom.llm import runs


def brute(words):
    """All runs, from every period on its own."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        same = [words[k] == words[k + q] for k in range(len(words) - q)] + [False]
        start = None
        for k, s in enumerate(same):
            if s and start is None:
                start = k
            if not s and start is not None:
                if k - start + q >= max(6, 4 * q):
                    found.setdefault((start, k - start + q), q)
                start = None
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(generator):
    letters = generator.choice([1, 2, 2, 3, 50])
    words = [generator.randrange(letters) for _ in range(generator.randint(0, 90))]
    for _ in range(generator.randint(0, 3)):
        unit = [generator.randrange(letters) for _ in range(generator.randint(1, 9))]
        at = generator.randint(0, len(words))
        words[at:at] = (unit * 12)[: generator.randint(0, 80)]
    return words


@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_runs_of_many_texts_equal_brute_force(monkeypatch, at_once):
    monkeypatch.setattr(runs, "AT_ONCE", at_once)
    generator = random.Random(3)
    for _ in range(40):
        texts = [repetitive(generator) for _ in range(generator.randint(1, 9))]
        owner, *found = runs.find_runs([np.array(t, dtype=np.int64) for t in texts])
        for i, words in enumerate(texts):
            assert [tuple(map(int, r)) for r in zip(*(x[owner == i] for x in found))] == brute(words)


def test_extensions_equal_word_by_word():
    generator = random.Random(4)
    for _ in range(30):
        words = np.array(repetitive(generator) + [99], dtype=np.int64)
        extensions = runs.Extensions(words)
        pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if i != j]
        if pairs:
            i, j = np.array(pairs).T
            expected = [next(k for k in range(len(words) + 1) if max(a, b) + k >= len(words) or words[a + k] != words[b + k]) for a, b in pairs]
            assert extensions.length(i, j).tolist() == expected


def test_cover_has_every_difference():
    assert {(a - b) % runs.PERIOD for a in runs.COVER for b in runs.COVER} == set(range(runs.PERIOD))


def test_awkward_rows(spark):
    row = "x y x y x y x y z"
    rows = [*small.AWKWARD, (20, row), (20, row), (21, "a " * 7 + "b"), (22, "\x0bw\x0c" * 6), (23, "  " * 6), (24, "a b c a b c a b c")]
    found = runs.periodic_runs(small.docs(spark, rows))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=small.key)
    expected = []
    for i, t in rows:
        words = (t or "").encode().split()
        spans = brute(words)
        dropped = {k for s, n, q in spans for k in range(s + q, s + n)}
        expected.append((i, len(words), sorted(spans, key=lambda r: (r[0], r[2])), b" ".join(w for k, w in enumerate(words) if k not in dropped).decode()))
    assert got == sorted(expected, key=small.key)
    assert (20, 9, [(0, 8, 2)], "x y z") in got and got.count((20, 9, [(0, 8, 2)], "x y z")) == 2 and (24, 9, [], "a b c a b c a b c") in got
    assert runs.periodic_runs(small.docs(spark, [])).count() == 0


def test_a_long_text_takes_time_in_proportion():
    import time

    generator = random.Random(5)
    words = np.array([generator.randrange(1000) for _ in range(400_000)], dtype=np.int64)
    words[1000:51000] = np.resize(words[:70], 50_000)
    began = time.perf_counter()
    owner, start, length, period = runs.find_runs([words])
    assert time.perf_counter() - began < 60 and any(p == 70 and n >= 50_000 for p, n in zip(period, length))
