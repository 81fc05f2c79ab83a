import hashlib
import re

import small
from pyspark.sql import functions as F

from creditloom.llm import sketch

PARTS = re.compile(rf"[^\n]{{{sketch.LEAST_CHARS},}}?[.!?](?=[ \t\n\x0b\f\r])|[^\n]+")


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def check(spark, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        text, following = t or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, e, x = (set(PARTS.findall(v)) for v in (text, edited, following))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(a, e), likeness(a, x), len(a - e), len(e - a)))
    found = sketch.fingerprints(small.docs(spark, rows)).collect()
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"], r["only_text"], r["only_edited"]) for r in found]
    assert sorted(got, key=small.key) == sorted(want, key=small.key)
    return found


def test_likeness_and_recovered_counts(spark):
    lines = [f"line {n} of a longer text." for n in range(700)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[:350] + ["changed"] + lines[351:])), (5000, "\n".join(lines[:40])), (5001, "\n".join(lines[:40])),
            (70_000, "A sentence here. " * 60), (2_000_000, "one\n\none\ntwo"), (-5, "é😀\nx" * 9)]
    found = check(spark, rows)
    prints = {r["doc_id"]: r["fingerprint"] for r in found}
    assert prints[5000] == prints[5001] != prints[1]


def test_awkward_rows(spark):
    check(spark, small.AWKWARD)
    check(spark, [(7, "alone\nhere")])
    assert sketch.fingerprints(small.docs(spark, [])).count() == 0


def test_following_ids_over_wide_ranges(spark):
    ids = sorted({(n * 7919) ** 3 % (1 << 40) for n in range(3000)} | set(range(-2000, 2000, 3)))
    found = dict(small.rows(sketch._following(spark.createDataFrame([(i,) for i in ids], "k long"))))
    assert found == {b: a for a, b in zip(ids, ids[1:])} | {ids[0]: None}


def test_peeling_recovers_the_difference(spark):
    left, right = list(range(100, 112)), list(range(106, 118))
    df = spark.createDataFrame([(left, right)], "l array<long>, r array<long>")
    cells = [sketch.sketch(sketch.placed(F.col(c), 0)) for c in "lr"]
    peeled = df.select(sketch.peel(sketch.subtract(*cells), 0).alias("p")).first()["p"]
    assert peeled["rest"] == 0
    assert {v["x"] for v in peeled["found"] if v["n"] == 1} == set(range(100, 106))
    assert {v["x"] for v in peeled["found"] if v["n"] == -1} == set(range(112, 118))


def test_no_python_on_the_way(spark):
    text = sketch.fingerprints(small.docs(spark)).select("near_next")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def test_kept_half_of_a_short_text_counts(spark):
    rows = [(1, "The river rose. It fell again. Nobody saw it. They slept on. The end came."), (2, "Quite another text.")]
    near = {r["doc_id"]: r["near_edited"] for r in sketch.fingerprints(small.docs(spark, rows)).collect()}
    assert near[1] > 0
