import random
from fractions import Fraction

import numpy as np
import pytest
import small

from creditloom.llm import hot, signatures


def brute_set(text, size=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    words = [w for w in lowered.split(" ") if w]
    return frozenset([" ".join(words)] if 0 < len(words) < size else (" ".join(words[i : i + size]) for i in range(len(words) - size + 1)))


def brute(rows):
    """(doc_id, n_shingles, component_id) from all pairs."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common) and common:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=small.key)


def corpus(generator, families=12, members=8):
    """Families of texts of many similarities, in chains and around a middle, and texts that share a passage only."""
    words = [f"w{i}" for i in range(400)]
    passage = [generator.choice(words) for _ in range(60)]
    rows = [(1000 + i, " ".join([*passage, *generator.choices(words, k=generator.randint(20, 60))])) for i in range(25)]
    doc = 0
    for f in range(families):
        base = generator.choices(words, k=generator.randint(30, 150))
        for _ in range(members):
            doc += 1
            rows.append((doc, " ".join(base) if generator.random() < 0.9 else " ".join(base).upper()))
            changed = list(base)
            for _ in range(generator.randint(0, 4)):
                changed[generator.randrange(len(changed))] = generator.choice(words)
            base = changed if f % 2 else base
            if not f % 2:
                rows.append((doc + 500, " ".join(changed)))
    generator.shuffle(rows)
    return rows


@pytest.mark.parametrize("forced", [False, True])
def test_components_equal_all_pairs(spark, monkeypatch, forced):
    if forced:  # partners in rounds to the end, hot keys apart, small groups
        monkeypatch.setattr(signatures, "PAIRS_EACH", 0)
        monkeypatch.setattr(signatures, "GROWTH", 2)
        monkeypatch.setattr(signatures, "GROUP_PAIRS", 3)
        monkeypatch.setattr(hot, "LEAST_HOT", 3)
    rows = corpus(random.Random(11))
    expected = brute(rows)
    assert len({c for _, _, c in expected}) < len(rows) - 60
    assert small.rows(signatures.near_duplicates(small.docs(spark, rows)).select("doc_id", "n_shingles", "component_id")) == expected


def test_awkward_rows(spark):
    rows = [*small.AWKWARD, (30, "A b"), (None, "one"), (None, "alone here with four words"), (31, "x y z w"), (32, "a b c"), (33, "a\x0bb\nc"), (34, "c b a")]
    found = signatures.near_duplicates(small.docs(spark, rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert small.rows(found) == brute(rows)
    assert signatures.near_duplicates(small.docs(spark, [])).count() == 0
    assert small.rows(signatures.near_duplicates(small.docs(spark, [(1, None), (2, " ")]))) == [(1, 0, 1), (2, 0, 2)]


def test_limit_is_exact():
    """17 common of 20 is 0.85, 16 of 19 is less; the confirmation counts whole sets."""
    share = Fraction("0.85")
    assert 17 * share.denominator >= 20 * share.numerator and 16 * share.denominator < 19 * share.numerator


def test_shingles_and_signatures():
    for text in [None, "", "a", "A b", "a b c", "a b c a b c a b c", *(t for _, t in small.AWKWARD)]:
        assert len(signatures.shingles((text or "").encode())) == len(brute_set(text))
    generator = np.random.default_rng(2)
    common, own = (generator.integers(0, 1 << 63, n, dtype=np.uint64) for n in (850, 150))
    agreed = np.mean([
        np.mean(signatures.signature(np.append(common, own[:75]) + np.uint64(s)) == signatures.signature(np.append(common, own[75:]) + np.uint64(s))) for s in range(20)
    ])
    assert abs(agreed - 0.85) < 0.03


@pytest.mark.parametrize("cut", [False, True])
def test_no_table_of_pairs(spark, monkeypatch, cut):
    """Many unlike copies of one text: all pairs are candidates, few are links, and no table has more than 30 rows for each text."""
    if cut:
        monkeypatch.setattr(signatures, "GROUP_PAIRS", 128)
    generator = random.Random(5)
    base = generator.choices([f"w{i}" for i in range(5000)], k=90)
    rows = []
    for doc in range(300):
        words = list(base)
        for _ in range(generator.randint(1, 8)):
            words[generator.randrange(len(words))] = f"own{generator.randrange(100_000)}"
        rows.append((doc, " ".join(words)))
    sizes = []

    def counted(df, write=signatures.materialise):
        sizes.append((written := write(df)).count())
        return written

    monkeypatch.setattr(signatures, "materialise", counted)
    found = small.rows(signatures.near_duplicates(small.docs(spark, rows)))
    expected = brute(rows)
    assert found == expected and 20 < len({c for _, _, c in expected}) < 280
    assert max(sizes) <= 30 * len(rows)


def test_links_of_a_task_span_its_components():
    share, sets = Fraction("0.85"), {1: range(20), 2: range(3, 20), 3: range(4, 20), 4: range(100, 120), 5: [*range(102, 120), 7]}
    held = [(root, root % 2, np.array(s, dtype=np.uint64)) for root, s in sets.items()]
    # 17 of 20 are a link and so are 16 of 17, 18 of 21 too; 16 of 20 are none.
    assert sorted(sorted(x) for x in signatures._span(held, False, share)) == [[1, 2], [2, 3], [4, 5]]
    assert sorted(sorted(x) for x in signatures._span([h for h in held if h[0] != 2], False, share)) == [[4, 5]]
    assert list(signatures._span([h for h in held if h[0] in (1, 3, 5)], True, share)) == []  # one side only
    assert list(signatures._span([(9, 0, held[0][2]), (9, 0, held[1][2])], False, share)) == []  # joined before
    assert share == Fraction(17, 20) and list(signatures._span([(1, 0, np.arange(20, dtype=np.uint64)), (2, 0, np.arange(16, dtype=np.uint64))], False, share)) == []


def test_linked_sets_share_a_band():
    generator = np.random.default_rng(4)
    for n in (20, 100, 1000):
        for _ in range(300):
            s = np.unique(generator.integers(0, 1 << 63, n, dtype=np.uint64))
            assert (signatures.bands(s) == signatures.bands(s[: -(-len(s) * 85 // 100)])).any()
