import random

import numpy as np
import small

from creditloom.llm import language, ngrams, quality, toxicity

BAD, GOOD = ["vile", "scummy", "scummily"], ["tree", "river", "stone", "cloud", "light", "paper", "window", "garden"]


def made(generator, toxic):
    words = [generator.choice(GOOD) for _ in range(30)]
    if toxic:
        words[generator.randrange(30)] = generator.choice(BAD)
    return " ".join(words)


def tables(spark, name, make, n=300):
    generator = random.Random(8)
    label = [i % 3 == 0 for i in range(n)]
    rows = [(i, make(generator, y)) for i, y in enumerate(label)] + [(1000 + i, t) for i, (_, t) in enumerate(small.AWKWARD)] + [(None, "vile")]
    labels = [(i, int(y), None) for i, y in enumerate(label) if i % 5] + [(None, 1, None), (1001, None, None), (7, 0, None), (99_999, 1, None)]
    return small.docs(spark, rows), spark.createDataFrame(labels, f"doc_id long, {name} int, label string"), label, len(rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, label, total = tables(spark, "toxic", made)
    model = toxicity.fit(docs, labels)
    found = {}
    rows = toxicity.severity(docs, model).collect()
    assert len(rows) == total and all(0 <= r["severity"] <= 2 and r["grade"] in (0, 1, 2) for r in rows)
    for r in rows:
        assert abs(r["severity"] - r["p_mild"] - 2 * r["p_severe"]) < 1e-9
        found[r["doc_id"]] = r["toxic"]
    assert [found[i] for i in range(0, 300, 5)] == label[::5]
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["toxic"] for r in rows)


def test_thresholds_are_ordered_and_the_gradient_is_right():
    generator = np.random.default_rng(1)
    rows = [sorted(generator.choice(6, size=3, replace=False)) for _ in range(60)]
    x = ngrams.Design(np.concatenate(rows), np.arange(0, 181, 3), np.zeros(60, dtype=int), 6)
    grades = np.array([min(2, int(0 in r) + int(1 in r)) for r in rows])
    weights, thresholds = toxicity.fit_ordinal(x, grades, 0.1)
    assert thresholds[0] < thresholds[1] and weights[0] > 1 and weights[1] > 1
    assert abs(x.dot(weights) - np.array([weights[r].sum() for r in rows])).max() < 1e-9
    # At the optimum no small step in any direction lowers the loss.
    def loss(w, t):
        score = x.dot(w)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        up, low = (1 / (1 + np.exp(score - edge[grades + k])) for k in (1, 0))
        return -np.log(up - low).sum() + 0.05 * w @ w
    best = loss(weights, thresholds)
    for _ in range(50):
        assert loss(weights + generator.normal(size=6) * 1e-2, thresholds + generator.normal(size=2) * 1e-2) > best - 1e-6


def junk(generator, good):
    words = [generator.choice(GOOD) for _ in range(12)]
    return " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)


def test_quality_on_held_out_rows(spark):
    docs, labels, label, total = tables(spark, "quality", junk)
    rows = quality.scores(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == total and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    found = {r["doc_id"]: r["predicted"] for r in rows}
    assert [found[i] for i in range(0, 300, 5)] == [int(y) for y in label[::5]]


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    generator = np.random.default_rng(3)
    index = np.concatenate([generator.choice(5, size=2, replace=False) for _ in range(40)])
    starts, values = np.arange(0, 81, 2), generator.normal(size=80)
    signs = np.where(generator.random(40) < 0.5, 1.0, -1.0)
    w = quality.dual_coordinate_descent(index, starts, values, signs, 5, 1.0, 2000)

    def primal(v):
        margins = np.array([v[index[a:b]] @ values[a:b] + v[-1] for a, b in zip(starts, starts[1:])])
        return v @ v / 2 + np.maximum(0, 1 - signs * margins).sum()

    best = primal(w)
    assert all(primal(w + generator.normal(size=6) * s) > best - 1e-2 for s in (1e-2, 1e-1, 1) for _ in range(100))


def test_empty_tables_and_no_labels(spark):
    docs, nothing = small.docs(spark, []), small.docs(spark, []).selectExpr("doc_id", "1 as toxic", "1 as quality")
    assert toxicity.severity(docs, toxicity.fit(docs, nothing)).count() == 0
    some = small.docs(spark)
    assert [r["score"] for r in quality.scores(some, quality.fit(some, nothing)).collect()] == [0.5] * len(small.AWKWARD)


SPEECH = {"en": "the cat and the dog went through the thick of the night", "es": "el perro y la niña comieron en la mañana española"}


def page(text, lang=None):
    return f"<html{f' lang={chr(34)}{lang}{chr(34)}' if lang else ''}><script>el la</script><body><p>{text}</p><!-- la niña --></body></html>"


def test_languages_of_pages(spark):
    docs = spark.createDataFrame([(i, SPEECH[k], k, "x") for i, k in enumerate(["en", "es"] * 20)] + [(None, "x", "en", ""), (50, None, "es", ""), (51, "y", None, "")],
                                 "doc_id long, text string, lang string, __id string")
    pages = [(i, f"https://www.uno.es/{i}", page(SPEECH["es"])) for i in range(12)] + [(20 + i, f"http://two.com:80/{i}", page(SPEECH["en"], "en-GB")) for i in range(12)]
    pages += [(40, "https://www.uno.es/x", page("")), (41, "http://two.com/y", None), (42, None, None), (43, "no address", page("", "es")), (43, "no address", page("", "es")),
              (None, "https://[::1]/", "<html lang=zz>"), (44, "https://other.es/", page(""))]
    table = spark.createDataFrame([(*p, "x", "x") for p in pages], "page_id long, url string, html string, host string, prior string")
    found = language.identify(table, language.fit(docs)).collect()
    lang = {r["page_id"]: r["lang"] for r in found}
    assert len(found) == len(pages) and all(0 < r["probability"] <= 1 + 1e-12 for r in found)
    assert {lang[i] for i in range(12)} == {"es"} and {lang[20 + i] for i in range(12)} == {"en"}
    assert lang[40] == "es" and lang[41] == "en" and lang[44] == "es"  # from the host, and from the suffix
    empty = table.filter("page_id < 0")
    assert language.identify(empty, language.fit(docs)).count() == 0
    assert {r["lang"] for r in language.identify(table, language.fit(docs.filter("doc_id < 0"))).collect()} == {"und"}


def test_visible_text():
    assert language.visible("<p>a&amp;b</p><style>x{}</style><script>var t='</p>';</script><!-- c -->d").split() == ["a&b", "d"]


def test_a_repeated_labelled_id_is_one_row_of_the_sample(spark):
    docs = small.docs(spark, [(1, "b")] * 50 + [(1, "a"), (1, None), (2, "c"), (3, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    assert small.rows(ngrams.labelled_sample(docs, labels)) == sorted([("a", 1), ("c", 0), (None, 0)], key=small.key)


def test_lookup_finds_the_features_of_the_vocabulary():
    generator = random.Random(3)
    words = ["a", "A", "Ab1", "ab1", "x-y", "Éa", "İ", "12", "w", "p", "1", "="]
    texts = [" ".join(generator.choices(words, k=generator.randrange(12))) for _ in range(200)] + ["", " ", "a\u00a0a\x1ca", *(t or "" for _, t in small.AWKWARD)]
    names = sorted({f for t in texts[:150] for f in quality.features(t)})[::2]
    vocabulary = ngrams.Vocabulary(names, np.ones((len(names), 2)), np.ones(2))
    lookup = quality.Lookup(vocabulary)
    assert [lookup.active(t) for t in texts] == [vocabulary.active(quality.features(t)) for t in texts]
