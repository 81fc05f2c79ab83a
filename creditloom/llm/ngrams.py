"""Labelled samples of documents as sparse indicators of n-grams, for the classifiers of this subpackage."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import pieces

Extract = Callable[[str], Iterable[str]]
#: Labelled rows of each class that a classifier is fitted on: those with the smallest hashed ids.
ROWS_PER_CLASS = 10_000
#: Counts that a task holds before it hands them on.
_HELD = 400_000


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """(text, label) of a bounded sample of ``labels`` (doc_id, label 0/1) joined to ``docs``.

    Rows without id or label say nothing; an id with several labels counts with the smallest, and one with several
    rows with its smallest text. The rows of the sample are at most twice ``rows_per_class``; their ids are broadcast.
    """
    one = labels.na.drop(subset=["doc_id", "label"]).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = None
    for value in (0, 1):
        part = one.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.select(F.col("doc_id").alias("__id"), "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    return rows.groupBy("__id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")


@dataclass
class Vocabulary:
    """Chosen features with the labelled documents of each class that have them, and the size of the classes."""

    names: list[str]
    counts: np.ndarray  # features x 2
    sizes: np.ndarray  # 2

    def __post_init__(self) -> None:
        self.index = {n: i for i, n in enumerate(self.names)}

    def active(self, features: Iterable[str]) -> list[int]:
        index = self.index
        return sorted(index[f] for f in set(features) & index.keys())

    def contrast(self) -> np.ndarray:
        """z-score of the difference of the two shares of documents that have a feature."""
        return _contrast(self.counts, self.sizes)


def _contrast(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    share = (counts + 0.5) / (sizes + 1.0)
    pooled = (counts.sum(axis=1) + 1.0) / (sizes.sum() + 2.0)
    spread = np.sqrt(pooled * (1 - pooled) * (1 / (sizes[0] + 1) + 1 / (sizes[1] + 1)))
    return (share[:, 1] - share[:, 0]) / np.maximum(spread, 1e-12)


def choose(sample: DataFrame, extract: Extract, size: int, least: int = 3) -> Vocabulary:
    """The ``size`` features whose presence differs most between the classes, of those in ``least`` documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: tuple[Counter, Counter] = (Counter(), Counter())

        def hand_on() -> pa.RecordBatch:
            names = list(tables[0].keys() | tables[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([t[n] for n in names], pa.int64()) for t in tables)]
            for t in tables:
                t.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "n0", "n1"])

        for batch in pieces(batches, 0):
            for text, label in zip(batch.column(0), batch.column(1)):
                tables[int(label.as_py())].update(set(extract(text.as_py() or "")))
                if len(tables[0]) + len(tables[1]) > _HELD:
                    yield hand_on()
        yield hand_on()

    sizes = np.zeros(2)
    for r in sample.groupBy("label").count().collect():
        sizes[int(r["label"])] = r["count"]
    found = sample.select("text", "label").mapInArrow(count, "feature string, n0 bigint, n1 bigint")
    found = found.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= least)
    differs = F.abs((F.col("n1") + 0.5) / (sizes[1] + 1) - (F.col("n0") + 0.5) / (sizes[0] + 1)) / F.sqrt(F.col("n0") + F.col("n1"))
    rows = found.orderBy(differs.desc(), "feature").limit(size).collect()  # a parameter bounds it
    counts = np.array([[r["n0"], r["n1"]] for r in rows], dtype=float).reshape(-1, 2)
    return Vocabulary([r["feature"] for r in rows], counts, sizes)


@dataclass
class Design:
    """Sparse indicators in rows: ``index[starts[i]:starts[i + 1]]`` are the features of row i."""

    index: np.ndarray
    starts: np.ndarray
    labels: np.ndarray
    width: int

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.index])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=np.repeat(values, self.lengths), minlength=self.width)


def design(sample: DataFrame, active: Callable[[str], list[int]], vocabulary: Vocabulary) -> Design:
    """Indicators of the sample, whose rows are bounded, in an order that only depends on their content.

    ``active`` gives the numbers of a text's features in the vocabulary, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            rows = [active(t.as_py() or "") for t in batch.column(0)]
            labels = pa.array([int(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), labels], names=["active", "label"])

    table = sample.select("text", "label").mapInArrow(run, "active array<int>, label bigint").toArrow()
    rows = sorted(zip(table["label"].to_pylist(), table["active"].to_pylist()))
    lengths = [len(a) for _, a in rows]
    return Design(
        np.array([i for _, a in rows for i in a], dtype=np.int64), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        np.array([y for y, _ in rows], dtype=np.int64), len(vocabulary.names),
    )
