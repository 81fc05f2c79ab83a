"""Random forests over the binned blocks of ``boosting``: all trees grow at once, level by level.

As in Spark ML each tree sees every row as often as a Poisson draw says, each node tries a random subset of the features, cuts
are chosen by Gini impurity, and sibling leaves of the same class are merged. The draws are other ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession

from .boosting import EPSILON, FOLLOWED, NODES, all_cuts, binned, large_table, nodes_of, saved_trees, whole_waves

#: Rows of a block, at least: counts of deep levels are as large as those of many rows.
BLOCK_ROWS = 1 << 19
#: Bytes of the counts of all trees that a task adds up at a time; a tree by itself may have more.
COUNT_BYTES = 64 << 20


def _columns() -> dict:
    return {"feature": np.zeros(1, np.int64), "cut": np.full(1, 255, np.uint8), "left": np.zeros(1, np.int64), "right": np.zeros(1, np.int64), "gain": np.full(1, -1.0)}


@dataclass
class _Tree:
    """Nodes as columns, the root first, children after their parents; a leaf leads to itself. ``rows``: those of each class."""

    columns: dict = field(default_factory=_columns)
    rows: np.ndarray = field(default_factory=lambda: np.zeros((1, 2), np.int64))
    #: Where each level begins, and the nodes of the last level that may be cut.
    levels: list[int] = field(default_factory=lambda: [0])
    open: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def routes(self) -> tuple[np.ndarray, ...]:
        return tuple(self.columns[c] for c in ("feature", "cut", "left", "right"))

    def cut(self, found: _Cuts, least: int, grow: bool) -> None:
        """Give the open nodes their cuts; their children are open where another cut is possible."""
        if len(self.levels) == 1:
            self.rows[0] = found.rows[0]
        split = np.flatnonzero(found.gain > 0) if grow else np.zeros(0, np.int64)
        nodes, first = self.open[split], len(self.rows)
        left, right = first + 2 * np.arange(len(split)), first + 1 + 2 * np.arange(len(split))
        for name, values in (("feature", found.feature[split]), ("cut", found.cut[split]), ("left", left), ("right", right), ("gain", found.gain[split])):
            self.columns[name][nodes] = values
        children = np.stack([found.left[split], found.rows[split] - found.left[split]], axis=1).reshape(-1, 2)
        new = np.arange(first, first + len(children))
        added = {"feature": np.zeros(len(new), np.int64), "cut": np.full(len(new), 255, np.uint8), "left": new, "right": new, "gain": np.full(len(new), -1.0)}
        self.columns = {name: np.concatenate([old, added[name]]) for name, old in self.columns.items()}
        self.rows = np.concatenate([self.rows, children])
        self.levels.append(first)
        self.open = new[(children.sum(axis=1) >= 2 * max(least, 1)) & (_gini(children) >= EPSILON)]

    def pruned(self) -> _Tree:
        """The tree whose sibling leaves of the same class are merged, from the bottom up."""
        left, right, here = self.columns["left"].copy(), self.columns["right"].copy(), np.arange(len(self.rows))
        label = self.rows[:, 1] > self.rows[:, 0]
        for begin, end in reversed(list(zip(self.levels, [*self.levels[1:], len(here)]))):
            at = here[begin:end][left[begin:end] != here[begin:end]]
            leaves = (left[left[at]] == left[at]) & (left[right[at]] == right[at])
            merged = at[leaves & (label[left[at]] == label[right[at]])]
            left[merged] = right[merged] = merged
        kept = np.zeros(len(here), bool)
        kept[0] = True
        for begin, end in zip(self.levels, [*self.levels[1:], len(here)]):
            at = here[begin:end][kept[begin:end]]
            kept[left[at]] = kept[right[at]] = True
        number, leaf = np.cumsum(kept) - 1, (left == here)[kept]
        columns = {name: values[kept] for name, values in self.columns.items()}
        columns |= {"left": number[left[kept]], "right": number[right[kept]], "gain": np.where(leaf, -1.0, columns["gain"])}
        return _Tree(columns, self.rows[kept])

    def saved(self, tree: int, cuts: Sequence[np.ndarray]) -> Iterator[tuple]:
        """Nodes as a saved Spark ML model has them."""
        impurity, label = _gini(self.rows), (self.rows[:, 1] > self.rows[:, 0]).astype(float)
        columns = [self.columns[c].tolist() for c in ("feature", "cut", "left", "right", "gain")]
        for node, (feature, cut, left, right, gain, own, is_one, rows) in enumerate(zip(*columns, impurity.tolist(), label.tolist(), self.rows.tolist())):
            at, split = ((-1, -1), (-1, [], -1)) if left == node else ((left, right), (feature, [float(cuts[feature][cut])], -1))
            yield tree, (node, is_one, own, [float(n) for n in rows], sum(rows), gain, *at, split)


def _gini(rows: np.ndarray) -> np.ndarray:
    """Gini impurity of the rows of two classes."""
    rows = rows.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - (rows**2).sum(axis=-1) / rows.sum(axis=-1) ** 2


@dataclass
class _Plan:
    """What is counted for a level of a tree: the cells of an open node are those of its features' bins, one after the other."""

    routes: tuple[np.ndarray, ...]
    level: int
    open: np.ndarray
    features: np.ndarray
    widths: np.ndarray

    @property
    def cells(self) -> int:
        return int(self.widths.sum())

    def starts(self) -> np.ndarray:
        return (np.cumsum(self.widths) - self.widths.ravel()).reshape(self.widths.shape)


@dataclass
class _Cuts:
    """The best cut of each open node of a tree, its rows by class, and those to the left; no gain, no cut."""

    gain: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    rows: np.ndarray
    left: np.ndarray


Block = tuple[tuple[int, int], np.ndarray, np.ndarray]  # number, bins, bins with the class as their last bit

#: Chance of a Poisson draw of mean 1 to be at most k, and the draw of each of 65536 equal shares of all chances that lies within one.
_CHANCES = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])
_SHARES = np.searchsorted(_CHANCES, np.arange(1 << 16) / (1 << 16), side="right")
_SPLIT = 255
_DRAWS = np.where(np.append(_SHARES[1:], _SPLIT) == _SHARES, _SHARES, _SPLIT).astype(np.uint8)


def drawn_times(rng: np.random.Generator, rows: int) -> np.ndarray:
    """How often each row is drawn: Poisson with mean 1."""
    share = rng.integers(0, 1 << 16, rows, dtype=np.uint16)
    times = _DRAWS.take(share)
    between = np.flatnonzero(times == _SPLIT)
    times[between] = np.searchsorted(_CHANCES, (share[between] + rng.random(len(between))) / (1 << 16), side="right")
    return times


def _opened(partition: int, rows: Iterable, features: int) -> Iterator[Block]:
    for number, row in enumerate(rows):
        bins, label = np.frombuffer(row["bins"], np.uint8).reshape(features, -1), np.frombuffer(row["signs"], np.int8) > 0
        yield (partition, number), bins, 2 * bins.astype(np.uint16) + label


def _counted(block: Block, plans: dict[int, _Plan], seed: int, kind: type, draw: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a block by cell and class, for each tree."""
    number, bins, classed = block
    flat, size = classed.ravel(), bins.shape[1]
    for tree, plan in plans.items():
        # The same whenever they are drawn.
        times = drawn_times(np.random.default_rng([seed, *number, tree]), size) if draw else np.ones(size, np.uint8)
        rows = np.flatnonzero(times)
        slot = np.zeros(len(rows), dtype=np.int64)
        if plan.level:
            places = np.full(len(plan.routes[0]), -1)
            places[plan.open] = np.arange(len(plan.open))
            slot = places.take(nodes_of(bins, plan.routes, plan.level, rows))
            if slot.min(initial=0) < 0:
                inside = np.flatnonzero(slot >= 0)
                rows, slot = rows.take(inside), slot.take(inside)
        starts, tried = 2 * plan.starts(), plan.features.shape[1]
        cells, place = np.empty((tried, len(rows)), dtype=np.int64), np.empty(len(rows), dtype=np.int64)
        for k in range(tried):
            np.take(np.ascontiguousarray(plan.features[:, k]) * size, slot, out=place, mode="clip")
            place += rows
            np.take(np.ascontiguousarray(starts[:, k]), slot, out=cells[k], mode="clip")
            cells[k] += flat.take(place)
        weights = np.tile(times.take(rows).astype(np.float64), tried)
        yield tree, np.bincount(cells.ravel(), weights, 2 * plan.cells).astype(kind)


def _best_cuts(item: tuple[int, np.ndarray], plans: dict[int, _Plan], least: int, least_gain: float) -> tuple[int, _Cuts]:
    """The best cuts of a tree's open nodes, the first of equal ones."""
    tree, counts = item
    plan, counts = plans[tree], counts.reshape(-1, 2).astype(np.int64)
    widths = plan.widths.ravel()
    starts = plan.starts().ravel()
    of = np.repeat(np.arange(len(widths)), widths)  # feature of a node that a cell belongs to
    below = np.cumsum(counts, axis=0)
    before = below[starts] - counts[starts]
    totals = np.add.reduceat(counts, starts, axis=0)
    left, whole = below - before[of], totals[of]
    right = whole - left
    n_left, n_right = left.sum(axis=1), right.sum(axis=1)
    allowed = np.flatnonzero(np.minimum(n_left, n_right) >= max(least, 1))
    l, r, n = left[allowed], right[allowed], (n_left + n_right)[allowed]
    found = _gini(whole[allowed]) - n_left[allowed] / n * _gini(l) - n_right[allowed] / n * _gini(r)
    gains = np.zeros(len(counts))
    gains[allowed] = np.where(found >= least_gain, found, 0.0)
    begin = starts.reshape(plan.widths.shape)[:, 0]
    most = np.maximum.reduceat(gains, begin)
    node = of // plan.widths.shape[1]
    hits = np.flatnonzero(gains == most[node])
    at = hits[np.unique(node[hits], return_index=True)[1]]
    return tree, _Cuts(most, plan.features.ravel()[of[at]], (at - starts[of[at]]).astype(np.uint8), whole[at], left[at])


def _groups(plans: dict[int, _Plan], kind: type) -> Iterator[dict[int, _Plan]]:
    """Plans whose counts a task holds together."""
    group, held = {}, 0
    for tree, plan in plans.items():
        size = 2 * np.dtype(kind).itemsize * plan.cells
        if group and held + size > COUNT_BYTES:
            yield group
            group, held = {}, 0
        group[tree], held = plan, held + size
    if group:
        yield group


def _forest(base: RDD, rows: int, widths: np.ndarray, estimator: RandomForestClassifier) -> list[_Tree]:
    count, depth, least, seed = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getSeed() % 2**63
    kind = np.int32 if rows < 2**30 else np.int64
    tried = len(widths) if count == 1 else math.ceil(math.sqrt(len(widths)))
    rng, trees = np.random.default_rng(seed), [_Tree() for _ in range(count)]
    cores = base.context.defaultParallelism
    for level in range(max(depth, 1)):
        plans = {}
        for i, tree in enumerate(trees):
            if len(tree.open):
                features = np.sort(rng.random((len(tree.open), len(widths))).argsort(axis=1)[:, :tried], axis=1)
                plans[i] = _Plan(tree.routes(), level, tree.open, features, widths[features])
        for group in _groups(plans, kind):
            counts = base.flatMap(partial(_counted, plans=group, seed=seed, kind=kind, draw=estimator.getBootstrap())).reduceByKey(np.add, min(len(group), cores))
            for i, found in counts.map(partial(_best_cuts, plans=group, least=least, least_gain=estimator.getMinInfoGain())).collect():
                trees[i].cut(found, least, grow=depth > 0)
    return trees


def fit_forest(rows: DataFrame, estimator: RandomForestClassifier) -> RandomForestClassificationModel:
    """A forest of the kind that ``estimator.fit(rows)`` fits.

    The counts of a tree's level are added up and its cuts chosen on the executors; the driver gets the cuts. A table of one block is
    left to Spark ML, as are settings that are not followed here and rows it refuses.
    """
    if (large := large_table(rows, estimator, FOLLOWED | {"numTrees", "bootstrap"})) is None:
        return estimator.fit(whole_waves(rows))
    named, count = large
    cuts = all_cuts(named, count, estimator)
    blocks = whole_waves(named).mapInArrow(partial(binned, cuts=cuts, block_rows=BLOCK_ROWS), "bins binary, signs binary")
    base = blocks.rdd.mapPartitionsWithIndex(partial(_opened, features=len(cuts))).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    trees = [tree.pruned() for tree in _forest(base, count, np.array([len(c) + 1 for c in cuts]), estimator)]
    base.unpersist()
    return _as_model(rows.sparkSession, estimator, trees, cuts)


def _as_model(spark: SparkSession, estimator: RandomForestClassifier, trees: Sequence[_Tree], cuts: Sequence[np.ndarray]) -> RandomForestClassificationModel:
    nodes = spark.createDataFrame([node for i, tree in enumerate(trees) for node in tree.saved(i, cuts)], NODES)
    kinds = ("classification.RandomForestClassificationModel", "classification.DecisionTreeClassificationModel")
    return RandomForestClassificationModel.load(saved_trees(nodes, estimator, kinds, [1.0] * len(trees), {"numFeatures": len(cuts), "numClasses": 2}, "gini"))
