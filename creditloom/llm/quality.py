"""Quality scores by naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their class counts; a linear model with hinge loss is fitted
on them by dual coordinate descent, and its margins are turned into probabilities by a logistic curve fitted
on margins of rows that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import ngrams
from .batches import pieces
from .toxicity import minimise

FEATURES = 16_384
#: Weight of the hinge loss, and of the fitted weights against their mean size.
COST, MIX = 1.0, 0.25
THRESHOLD = 0.3


def shape(word: str) -> str:
    """The word with runs of capitals, small letters, digits and other letters as one sign each, punctuation as it is."""
    word = word[:64]
    if word.isalpha():  # most words
        if word.islower():
            return "x"
        if word[0].isupper() and word[1:].islower():
            return "Xx"
    signs = []
    for c in word:
        if c.isalpha():
            c = "X" if c.isupper() else "x"
        elif c.isdigit():
            c = "0"
        if not signs or c != signs[-1] or not c.isalnum():
            signs.append(c)
    return "".join(signs[:8])


#: Shapes of words that a worker has met, bounded by _MOST_SHAPES.
_shapes: dict[str, str] = {}
_MOST_SHAPES = 100_000


def _remembered(word: str) -> str:
    if len(_shapes) > _MOST_SHAPES:
        _shapes.clear()
    _shapes[word] = value = shape(word)
    return value


def _words_and_forms(text: str) -> tuple[list[str], list[str]]:
    """Words in small letters, and the shapes of the words as they are; a word that repeats the one before has shape ``=``."""
    words = text.split()
    forms = list(map(_shapes.get, words))
    if None in forms:
        forms = [form or _remembered(word) for form, word in zip(forms, words)]
    repeats = list(map(eq, words, words[1:]))
    if True in repeats:
        forms[1:] = ["=" if same else form for same, form in zip(repeats, forms[1:])]
    return text.lower().split(), forms


def features(text: str) -> set[str]:
    """Words, pairs of words, and runs of one to three word shapes."""
    low, forms = _words_and_forms(text)
    found = {"w " + w for w in set(low)} | {f"p {a} {b}" for a, b in set(zip(low, low[1:]))}
    found |= {"1 " + f for f in set(forms)} | {f"2 {a} {b}" for a, b in set(zip(forms, forms[1:]))}
    return found | {f"3 {a} {b} {c}" for a, b, c in set(zip(forms, forms[1:], forms[2:]))}


class Lookup:
    """The features of a vocabulary by kind, so that those of a text are found without spelling out all others."""

    def __init__(self, vocabulary: ngrams.Vocabulary) -> None:
        self.kinds: dict[str, dict] = {kind: {} for kind in "wp123"}
        for i, name in enumerate(vocabulary.names):
            kind, *parts = name.split(" ")
            self.kinds[kind][parts[0] if len(parts) == 1 else tuple(parts)] = i

    def active(self, text: str) -> list[int]:
        """``vocabulary.active(features(text))``."""
        low, forms = _words_and_forms(text)
        runs = {"w": low, "p": zip(low, low[1:]), "1": forms, "2": zip(forms, forms[1:]), "3": zip(forms, forms[1:], forms[2:])}
        found = []
        for kind, index in self.kinds.items():
            found.extend(map(index.__getitem__, index.keys() & runs[kind]))
        return sorted(found)


def log_ratios(vocabulary: ngrams.Vocabulary) -> np.ndarray:
    """log of (smoothed share among the counts of class 1) / (that of class 0)."""
    p, q = vocabulary.counts[:, 1] + 1, vocabulary.counts[:, 0] + 1
    return np.log(p / p.sum()) - np.log(q / q.sum()) if len(p) else np.zeros(0)


def dual_coordinate_descent(
    index: np.ndarray, starts: np.ndarray, values: np.ndarray, signs: np.ndarray, width: int, cost: float = COST, rounds: int = 60
) -> np.ndarray:
    """Weights (the last is the bias) that minimise |w|^2 / 2 + cost * sum of max(0, 1 - sign * w.x)."""
    w, alpha = np.zeros(width + 1), np.zeros(len(signs))
    squares = np.array([values[a:b] @ values[a:b] + 1 for a, b in zip(starts, starts[1:])])
    order = np.random.default_rng(42)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(signs)):
            own, x = index[starts[i] : starts[i + 1]], values[starts[i] : starts[i + 1]]
            slope = signs[i] * (w[own] @ x + w[-1]) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), cost)
            if new != alpha[i]:
                change = (new - alpha[i]) * signs[i]
                worst = max(worst, abs(new - alpha[i]))
                w[own] += change * x
                w[-1] += change
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


@dataclass
class QualityModel:
    vocabulary: ngrams.Vocabulary
    weights: np.ndarray  # of the indicators themselves; the ratios are multiplied in
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.vocabulary)

    def margin(self, active: list[int]) -> float:
        size = np.sqrt(float(self.ratios[active] @ self.ratios[active]))
        return float(self.weights[active].sum()) / max(size, 1e-9) + self.bias if active else self.bias

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(self.lookup.active(text)) + self.offset, -500, 500))))


def _train(x: ngrams.Design, rows: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    lengths = x.lengths[rows]
    index = np.concatenate([x.index[x.starts[i] : x.starts[i + 1]] for i in rows]) if len(rows) else x.index[:0]
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    values = _unit(ratios[index], starts)
    w = dual_coordinate_descent(index, starts, values, np.where(x.labels[rows] == 1, 1.0, -1.0), x.width)
    mean = np.abs(w[:-1]).mean() if x.width else 0.0
    return ((1 - MIX) * mean + MIX * w[:-1]) * ratios, float(w[-1]) * MIX


def _unit(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values**2)])
    size = np.sqrt(np.maximum(sums[starts[1:]] - sums[starts[:-1]], 1e-18))
    return values / np.repeat(size, np.diff(starts))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ngrams.ROWS_PER_CLASS) -> QualityModel:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0/1, any other columns).

    Fitted on at most ``rows_per_class`` labelled rows of each class. Without labelled rows all scores are 0.5.
    """
    sample = ngrams.labelled_sample(docs, labels.select("doc_id", labels["quality"].alias("label")), rows_per_class)
    vocabulary = ngrams.choose(sample, features, FEATURES)
    x = ngrams.design(sample, Lookup(vocabulary).active, vocabulary)
    ratios = log_ratios(vocabulary)
    everything = np.arange(len(x.labels))
    weights, bias = _train(x, everything, ratios)
    # Margins of unseen rows: the model of one half, applied to the other.
    margins = np.zeros(len(x.labels))
    for half in (0, 1):
        seen, unseen = everything[everything % 2 == half], everything[everything % 2 != half]
        w, b = _train(x, seen, ratios)
        size = np.sqrt(np.maximum(x.dot(ratios**2), 1e-18))
        margins[unseen] = (x.dot(w) / size + b)[unseen]
    slope, offset = _logistic(margins, x.labels)
    return QualityModel(vocabulary, weights, ratios, bias, slope, offset)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve; labels are drawn in a little, so separable margins keep it finite."""
    ones, zeros = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        z = p[0] * margins + p[1]
        value = np.sum(np.logaddexp(0, z) - target * z)
        miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        return float(value), np.array([miss @ margins, miss.sum()])

    slope, offset = minimise(loss, np.array([1.0, 0.0]), 100) if len(labels) else (1.0, 0.0)
    return float(slope), float(offset)


def scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text, any other columns).

    Only the text is used, whole. Null and empty texts have no features and get the score of the bias;
    repeated rows come back as often as they came; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = pa.array([model.score(t.as_py() or "") for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
