"""Language of web pages by Bayesian fusion of evidence.

The posterior of a page is the product of three terms: the likelihood of its visible text under character
trigrams of each language, the likelihood of its declared markup language, and a prior for its host. Host priors are
smoothed along the address: a host towards its domain, a domain towards its suffix, a suffix towards all pages. The
tables for declarations, suffixes, domains and hosts are grouped sums, over all pages, of what the texts say.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import materialise
from .batches import pieces

#: Labelled documents of each language that the text model is fitted on: those with the smallest hashed ids.
ROWS_PER_LANGUAGE = 2_000
TRIGRAMS = 50_000
#: Overlapping trigrams are no independent evidence, so their log-likelihood counts for a part.
TEMPER = 0.2
#: Pages that a parent in the address counts for.
STRENGTH = 5.0
_HIDING = re.compile(r"<(script|style)\b", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_HTML = re.compile(r"<html\b[^>]*", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)
_LETTERS = re.compile(r"[\W\d_]+")


def visible(page: str) -> str:
    """Text without scripts, styles, comments and tags, in one scan: once an end is not found, it is not looked for again.

    A script, style or comment that does not end hides its first tag only; a tag that does not end hides nothing.
    """
    kept, at, start, absent = [], 0, page.find("<"), set()
    while start >= 0:
        end = -1
        hiding = _HIDING.match(page, start)
        if hiding and (name := hiding[1].lower()) not in absent:
            found = _ENDS[name].search(page, hiding.end())
            end = found.end() if found else end
            absent |= set() if found else {name}
        elif page.startswith("<!--", start) and "-->" not in absent:
            found = page.find("-->", start + 4)
            end = found + 3 if found >= 0 else end
            absent |= set() if found >= 0 else {"-->"}
        if end < 0 and ">" not in absent:
            end = page.find(">", start) + 1 or -1
        if end < 0:
            break  # no tag ends any more
        kept += [page[at:start], " "]
        at, start = end, page.find("<", end)
    return html.unescape("".join(kept) + page[at:])


def declared_language(page: str) -> str | None:
    """The language that a page's first html tag with one declares, in small letters."""
    found = (_LANG.search(tag[0], 5) for tag in _HTML.finditer(page))
    return next((m[1].lower() for m in found if m), None)


def trigrams(text: str) -> Counter:
    """Trigrams of small letters, words set off by blanks."""
    plain = " " + _LETTERS.sub(" ", text.lower()).strip() + " "
    return Counter(map("".join, zip(plain, plain[1:], plain[2:]))) if len(plain) > 2 else Counter()


@dataclass
class TextModel:
    languages: list[str]
    index: dict[str, int]
    weights: np.ndarray  # trigrams x languages: log-probabilities

    def log_likelihood(self, text: str) -> list[float]:
        counts = trigrams(text)
        known = [(self.index[g], n) for g, n in counts.items() if g in self.index]
        if not known:
            return [0.0] * len(self.languages)
        rows, times = zip(*known)
        total = np.array(times, dtype=float) @ self.weights[list(rows)] * TEMPER
        return list(map(float, total - total.max()))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, size: int = TRIGRAMS) -> TextModel:
    """Text model from ``docs`` (doc_id, text, lang); rows without a language are left out.

    The sample is bounded by ``rows_per_language`` rows of each language, the model by ``size`` trigrams.
    """
    labelled = docs.filter("lang is not null and doc_id is not null").select("doc_id", "lang")
    languages = sorted(r["lang"] for r in labelled.groupBy("lang").count().collect())  # one row per language
    chosen = None
    for language in languages:
        part = labelled.filter(F.col("lang") == language).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_language)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return TextModel(["und"], {}, np.zeros((0, 1)))
    ids = chosen.select(F.col("doc_id").alias("__id")).distinct()
    texts = docs.select("doc_id", "text", "lang").filter("lang is not null")
    sample = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            flat = [(lang, g, n) for lang, c in held.items() for g, n in c.items()]
            columns = list(zip(*flat)) or [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "gram", "n"])

        for batch in pieces(batches, 0):
            for text, lang in zip(batch.column(0), batch.column(1)):
                held.setdefault(lang.as_py(), Counter()).update(trigrams(text.as_py() or ""))
            if sum(map(len, held.values())) > 500_000:
                yield rows()
        yield rows()

    counted = sample.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    wide = counted.groupBy("gram").pivot("lang", languages).agg(F.first("n")).na.fill(0)
    total = sum((F.col(f"`{lang}`") for lang in languages[1:]), F.col(f"`{languages[0]}`"))
    rows = wide.orderBy(total.desc(), "gram").limit(size).collect()  # a parameter bounds it
    counts = np.array([[r[lang] for lang in languages] for r in rows], dtype=float).reshape(-1, len(languages)) + 0.5
    return TextModel(languages, {r["gram"]: i for i, r in enumerate(rows)}, np.log(counts / counts.sum(axis=0)))


def _normal(logs: Column) -> Column:
    """Probabilities from logarithms."""
    powers = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    return F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _sums(vector: str, width: int) -> Column:
    return F.array(*[F.sum(F.col(vector)[i]) for i in range(width)])


def _smoothed(own: Column, parent: Column) -> Column:
    """Shares of ``own`` sums, drawn towards the ``parent`` shares by ``STRENGTH`` pages."""
    every = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(own, parent, lambda a, b: (a + b * STRENGTH) / (every + STRENGTH))


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, host, domain, suffix, declared, logs) of every row of ``pages`` (page_id, url, html)."""
    known = set(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            rows = []
            for url, page in zip(batch.column(1), batch.column(2)):
                found = _HOST.match((url.as_py() or "").strip())
                host = found[1].lower().strip(".") if found else ""
                labels = host.split(".")
                source = page.as_py() or ""
                said = declared_language(source)
                declared = "none" if said is None else said if said in known else "other"
                rows.append((host, ".".join(labels[-2:]), labels[-1], declared, model.log_likelihood(visible(source))))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.string()] * 4 + [pa.list_(pa.float64())]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "domain", "suffix", "declared", "logs"])

    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, domain string, suffix string, declared string, logs array<double>"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, suffix) of every row of ``pages`` (page_id, url, html, any other columns).

    lang is the most probable language, the first by name of equals; text_lang what the text alone says. A
    page does not count for the prior of its own host. Null or empty pages and addresses are judged by the
    evidence that is left, at worst by the share of each language among all pages; pages without an address share
    the host ``''``. Repeated rows come back as often as they came; an empty table gives an empty one.
    """
    width = len(model.languages)
    names = F.array(*[F.lit(n) for n in model.languages])
    seen = materialise(evidence(pages, model).withColumn("shares", _normal(F.col("logs"))))
    # Sums are combined before each shuffle, so a host with a third of all pages is one row per task.
    hosts = materialise(seen.groupBy("suffix", "domain", "host").agg(_sums("shares", width).alias("host_sum")))
    domains = hosts.groupBy("suffix", "domain").agg(_sums("host_sum", width).alias("domain_sum"))
    suffixes = domains.groupBy("suffix").agg(_sums("domain_sum", width).alias("suffix_sum"))
    total = suffixes.agg(_sums("suffix_sum", width)).first()[0] or [0.0] * width
    total = [v or 0.0 for v in total]
    overall = F.array(*[F.lit((v + 1) / (sum(total) + width)) for v in total])
    priors = (
        hosts.join(domains, ["suffix", "domain"]).join(suffixes, "suffix")
        .withColumn("suffix_prior", _smoothed(F.col("suffix_sum"), overall))
        .withColumn("prior", _smoothed(F.col("domain_sum"), F.col("suffix_prior")))
        .select("host", "host_sum", "prior")
    )
    priors = materialise(priors)
    said = {r["declared"]: r["sums"] for r in seen.groupBy("declared").agg(_sums("shares", width).alias("sums")).collect()}
    kinds = ["none", "other", *model.languages]  # the only values of declared
    table = [[(said[k][i] if k in said else 0.0) for k in kinds] for i in range(width)]
    chance = {k: [np.log((row[j] + 0.5) / (sum(row) + 0.5 * len(kinds))) for row in table] for j, k in enumerate(kinds)}
    likely = F.create_map(*[x for k, v in chance.items() for x in (F.lit(k), F.array(*[F.lit(float(p)) for p in v]))])
    joined = seen.join(priors, "host")
    others = F.zip_with("host_sum", "shares", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    joined = joined.withColumn("prior", _smoothed(others, F.col("prior"))).withColumn("channel", likely[F.col("declared")])
    fused = F.zip_with(F.zip_with("logs", "prior", lambda a, b: a + F.log(b)), F.col("channel"), lambda a, b: a + b)
    result = joined.withColumn("posterior", _normal(fused))

    def best(vector: str) -> Column:
        return F.get(names, (F.array_position(F.col(vector), F.array_max(vector)) - 1).cast("int"))

    return result.select(
        "page_id", best("posterior").alias("lang"), F.array_max("posterior").alias("probability"), best("shares").alias("text_lang"),
        "declared", "suffix",
    )
