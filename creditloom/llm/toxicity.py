"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector serves all ordered thresholds. x has the words
of a text and the beginnings of its words, as far as they set toxic texts apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import ngrams
from .batches import pieces

GRADES = 3
FEATURES = 4096
#: Lengths of the word beginnings that are features: inflected forms share them.
STEMS = (4, 5, 6)
#: Strength of the quadratic penalty on the weights.
PENALTY = 1.0
#: A text is rejected if any grade above 0 is at least so probable.
REJECT = 0.4
_WORDS = re.compile(r"\w+").findall


def features(text: str) -> set[str]:
    words = set(_WORDS(text.lower()))
    return words | {f"^{w[:n]}" for n in STEMS for w in words if len(w) > n}


def severity_grades(design: ngrams.Design, vocabulary: ngrams.Vocabulary) -> np.ndarray:
    """Grades 0, 1, 2 of labelled rows: the label says whether a text is toxic, and a toxic text is severe (2) if
    it has more of the features typical of toxic texts than half of the toxic texts have."""
    typical = (vocabulary.contrast() > 4).astype(float)
    load = design.dot(typical)
    toxic = design.labels == 1
    middle = np.median(load[toxic]) if toxic.any() else 0.0
    return np.where(toxic, np.where(load > middle, 2, 1), 0)


@dataclass
class OrdinalModel:
    vocabulary: ngrams.Vocabulary
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: float) -> list[float]:
        upto = [*(1 / (1 + np.exp(np.clip(score - self.thresholds, -500, 500)))), 1.0]
        return [float(b - a) for a, b in zip([0.0, *upto], upto)]

    def predict(self, text: str) -> list[float]:
        return self.probabilities(float(self.weights[self.vocabulary.active(features(text))].sum()))


def fit_ordinal(x: ngrams.Design, grades: np.ndarray, penalty: float = PENALTY, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of least penalised negative log-likelihood; gaps of thresholds are exponentials."""
    levels = GRADES - 1
    share = np.array([(np.sum(grades <= k) + 1) / (len(grades) + 2) for k in range(levels)])
    first = np.log(share / (1 - share))
    start = np.concatenate([np.zeros(x.width), [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])

    def cuts(p: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([[p[x.width]], np.exp(p[x.width + 1 :])]))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        score = x.dot(p[: x.width])
        edge = np.concatenate([[-np.inf], cuts(p), [np.inf]])
        upper = 1 / (1 + np.exp(np.clip(score - edge[grades + 1], -500, 500)))
        lower = 1 / (1 + np.exp(np.clip(score - edge[grades], -500, 500)))
        chance = np.maximum(upper - lower, 1e-12)
        slope_up, slope_low = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        gradient = x.back(slope_up - slope_low) + penalty * p[: x.width]
        by_cut = np.array([slope_low[grades == k + 1].sum() - slope_up[grades == k].sum() for k in range(levels)])
        later = np.cumsum(by_cut[::-1])[::-1]
        by_parameter = np.concatenate([later[:1], later[1:] * np.exp(p[x.width + 1 :])])
        value = -np.log(chance).sum() + penalty / 2 * float(p[: x.width] @ p[: x.width])
        return value, np.concatenate([gradient, by_parameter])

    best = minimise(loss, start, steps)
    return best[: x.width], cuts(best)


def minimise(loss, point: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    value, gradient = loss(point)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(gradient).max() < 1e-4:
            break
        direction, used = gradient.copy(), []
        for s, y in reversed(pairs):
            a = s @ direction / (s @ y)
            direction -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            direction *= s @ y / (y @ y)
        else:
            direction /= max(1.0, np.linalg.norm(gradient))
        for (s, y), a in zip(pairs, reversed(used)):
            direction += s * (a - y @ direction / (s @ y))
        step, slope = 1.0, gradient @ direction
        while step > 1e-10:
            new = point - step * direction
            new_value, new_gradient = loss(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - point, new_gradient - gradient
        if s @ y > 1e-12:
            pairs = [*pairs[-(memory - 1) :], (s, y)]
        if value - new_value < 1e-9 * max(1.0, abs(value)):
            return new
        point, value, gradient = new, new_value, new_gradient
    return point


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ngrams.ROWS_PER_CLASS) -> OrdinalModel:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0/1, any other columns).

    Fitted on at most ``rows_per_class`` labelled rows of each class. Without labelled rows, or with one class,
    it holds every text for what the labels say on average.
    """
    sample = ngrams.labelled_sample(docs, labels.select("doc_id", labels["toxic"].alias("label")), rows_per_class)
    vocabulary = ngrams.choose(sample, features, FEATURES)
    x = ngrams.design(sample, lambda text: vocabulary.active(features(text)), vocabulary)
    weights, thresholds = fit_ordinal(x, severity_grades(x, vocabulary))
    return OrdinalModel(vocabulary, weights, thresholds)


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, severity, p_mild, p_severe, grade, toxic) of every row of ``docs`` (doc_id, text, any other columns).

    severity is the expected grade, 0 to 2; grade the most probable one, the lower of equals; toxic whether a
    grade above 0 has a probability of ``REJECT`` or more. Texts are read whole. Null and empty texts have no features
    and get what the thresholds say; repeated rows come back as often as they came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            chances = [model.predict(t.as_py() or "") for t in batch.column(1)]
            columns = [
                pa.array([sum(k * p for k, p in enumerate(c)) for c in chances], pa.float64()),
                *(pa.array([c[k] for c in chances], pa.float64()) for k in range(1, GRADES)),
                pa.array([max(range(GRADES), key=lambda k: (c[k], -k)) for c in chances], pa.int32()),
                pa.array([1 - c[0] >= REJECT for c in chances], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    kinds = [("severity", T.DoubleType()), ("p_mild", T.DoubleType()), ("p_severe", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.BooleanType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in kinds)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def accepted(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all columns."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, where):
            keep = [1 - model.predict(t.as_py() or "")[0] < REJECT for t in batch.column(where)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
