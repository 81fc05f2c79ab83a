import random

import small

from creditloom.llm import decontaminate
from creditloom.llm.decontaminate import Matcher, Pattern, normalise, places


def distance_in(pattern, text):
    """Least edits that turn ``pattern`` into a part of ``text``."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def word(generator, size, letters="abcd e"):
    return "".join(generator.choice(letters) for _ in range(size))


def test_bit_parallel_distance():
    generator = random.Random(1)
    for _ in range(200):
        pattern, text = word(generator, generator.randint(1, 90)), word(generator, generator.randint(0, 120))
        assert Pattern(pattern).best(text)[0] == distance_in(pattern, text)


def test_matcher_finds_exactly_the_items_within_the_budget():
    generator = random.Random(2)
    hits = 0
    for _ in range(400):
        items = [(n, normalise(word(generator, generator.randint(5, 60)))) for n in range(3)]
        inside = list(generator.choice(items)[1])
        for _ in range(generator.randint(0, 6)):
            if inside:
                at, kind = generator.randrange(len(inside)), generator.random()
                inside[at : at + (kind < 0.6)] = [] if kind < 0.3 else [generator.choice("abcd e")]
        text = normalise(word(generator, 40) + "".join(inside) + word(generator, 30))
        matcher = Matcher(items, 0.15)
        found = matcher.find(text)
        for n, (_, item) in enumerate(matcher.items):
            least = distance_in(item, text)
            assert (least <= min(int(0.15 * len(item)), len(item) - 1)) == (n in found)
            if n in found:
                hits += 1
                distance, start, end, _ = found[n]
                assert least <= distance and distance_in(item, text[start:end]) == distance
    assert hits > 100


def test_places_of_normalised_characters():
    text = "  Ab\n\n c İx  d "
    assert normalise(text) == "ab c İx d"
    where = places(text)
    assert [text[p].lower() for p, c in zip(where, normalise(text)) if c != " "] == [c.lower() for c in normalise(text) if c != " "]


def test_documents_with_items(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards watch."
    edited = item.replace("quick", "quack").replace("seven", "sevn")
    rows = [*small.AWKWARD, (20, "Before. " + item + " After."), (21, "x" * 50 + "\n" + edited.upper().replace(" ", "\n ")), (22, "The quick brown fox."), (20, item)]
    benchmark = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "  ", "x"), (1, item, "x")], "item_id long, text string, doc_id string")
    found = small.rows(decontaminate.matches(small.docs(spark, rows), benchmark).select("doc_id", "item_id", "distance").distinct())
    assert found == [(20, 1, 0), (21, 1, 2)]
    spot = decontaminate.matches(small.docs(spark, rows), benchmark).filter("doc_id = 21").first()
    assert rows[-3][1][spot["start"] : spot["end"]] == edited.upper().replace(" ", "\n ")
    kept = decontaminate.clean(small.docs(spark, rows), benchmark)
    assert kept.columns == small.docs(spark, []).columns
    assert small.rows(kept.select("doc_id", "text")) == sorted(((i, t) for i, t in rows if i not in (20, 21)), key=small.key)
    assert decontaminate.matches(small.docs(spark, []), benchmark).count() == 0
    assert decontaminate.matches(small.docs(spark, rows), benchmark.filter("item_id > 9")).count() == 0


def test_blocks_cover_all_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 40)
    items = [(n, f"item number {n} says {'abcdefghij'[n % 10] * 12}") for n in range(8)]
    documents = small.docs(spark, [(n, "so " + t + " it") for n, t in items])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(documents, benchmark, 0.0).collect()}
    assert found == {(n, n) for n, _ in items}
    assert decontaminate.clean(documents, benchmark, 0.0).count() == 0
