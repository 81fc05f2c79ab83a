import random

import small
import xxhash

from creditloom.llm import simhash
from creditloom.llm.links import components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\v", " ").replace("\f", " ")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(values, links):
    least = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_fingerprints_are_majority_bits():
    texts = [None, "", " \x0b\x0c", "One", "a B", "a b c", "a b c d e f g a b c", "x y z w", "É é É é"] + [t for _, t in small.AWKWARD]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) % (1 << 64) == brute_fingerprint(t)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)] + [(499, 559), (500, 500)]
    links = chain + star + [(7, 3), (3, 7), (None, 4)]
    df = spark.createDataFrame(links, "a long, b long")
    expected = brute_classes({x for l in links for x in l if x is not None and x not in (4,)}, [l for l in links if None not in l])
    assert dict(small.rows(components(df))) == expected
    assert small.rows(components(df.filter("a < 0"))) == []


def test_every_close_pair_is_linked_under_any_layout(spark):
    generator = random.Random(5)
    values = set()
    for _ in range(60):
        base = generator.getrandbits(64)
        values.add(base)
        for _ in range(generator.randint(0, 6)):
            flipped = base
            for b in generator.sample(range(64), generator.randint(1, 5)):
                flipped ^= 1 << b
            values.add(flipped)
    close = {(min(a, b), max(a, b)) for a in values for b in values if a != b and (a ^ b).bit_count() <= 3}
    signed = {simhash._signed(v): v for v in values}
    df = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    some = list(range(64))
    generator.shuffle(some)
    layouts = [
        simhash.layout(df, 3),
        [simhash.Partition(tuple(some[16 * i : 16 * i + 16]), 0) for i in range(4)],
        [simhash.Partition(tuple(some[:32]), 1), simhash.Partition(tuple(some[32:]), 1)],
        [simhash.Partition(tuple(some[:24]), 1), simhash.Partition(tuple(some[24:48]), 0), simhash.Partition(tuple(some[48:]), 0)],
        [simhash.Partition(tuple(some[:40]), 2), simhash.Partition(tuple(some[40:]), 0)],
    ]
    for parts in layouts:
        found = {tuple(sorted((signed[a], signed[b]))) for a, b in small.rows(simhash.hamming_links(df, 3, parts))}
        assert found == close
    assert sum(p.threshold + 1 for p in layouts[0]) == 4


def test_near_duplicates_of_awkward_rows(spark):
    found = simhash.near_duplicates(small.docs(spark))
    brute = [(i, brute_fingerprint(t)) for i, t in small.AWKWARD]
    links = [(a, b) for a in {f for _, f in brute} for b in {f for _, f in brute} if (a ^ b).bit_count() <= 3]
    root = brute_classes({f for _, f in brute}, links)
    least = {}
    for i, f in brute:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    expected = sorted(((i, simhash._signed(f), least.get(root[f])) for i, f in brute), key=small.key)
    assert small.rows(found) == expected
    assert simhash.near_duplicates(small.docs(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    kept = simhash.first_of_each(small.docs(spark))
    assert kept.columns == small.docs(spark, []).columns
    ids = [(r["doc_id"], r["text"]) for r in kept.collect()]
    classes = {r["component_id"] for r in simhash.near_duplicates(small.docs(spark)).filter("component_id is not null").collect()}
    assert {i for i, _ in ids if i is not None} == classes  # doc_id 8 names two texts: both stay
    assert sorted(t for i, t in ids if i == 8) == ["knot", "tie"]
    assert (5, "a b") in ids and ids.count((5, "a b")) == 1 and (9, "A B") not in ids
    assert (1, None) in ids and (2, "") not in ids and (None, "x y z w") in ids and (None, None) not in ids
    assert simhash.first_of_each(small.docs(spark, [])).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    near = "one two three four five six seven"
    rows = [(8, "alpha beta gamma delta"), (8, "quite another text here"), (1, near), (None, near.upper()), (None, "no copy of anything"), (None, None), (None, ""),
            (None, None), (3, "repeated row"), (3, "repeated row"), (3, "Repeated row")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.first_of_each(small.docs(spark, rows)).collect()]
    with_id = sorted(r for r in kept if r[0] is not None)
    assert with_id[0] == (1, near) and [r for r in with_id if r[0] == 8] == [(8, "alpha beta gamma delta"), (8, "quite another text here")]
    assert len([r for r in with_id if r[0] == 3]) == 1
    without = [t for i, t in kept if i is None]
    assert "no copy of anything" in without and len([t for t in without if not t]) == 1 and near.upper() not in without
