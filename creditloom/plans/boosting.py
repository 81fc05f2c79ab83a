"""Boosted trees of a GBTClassifier, grown level by level from histograms of binned rows.

The trees are those of Spark ML: the same candidate cuts, gains, losses and stopping rules. Only the way there differs: a
row is one byte for each feature in a block of columns, so a task adds up the histograms of a block by vector operations, and of
two sibling nodes only the smaller one is added up. The result is a Spark ML model.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import scratch_root

#: Rows of a block, at least; a partition of fewer rows is one block. A table of no more rows is left to Spark ML.
BLOCK_ROWS = 1 << 17
#: Partitions whose histograms the driver adds up itself; those of more are added up on the executors first.
DIRECT = 64
#: Trees after which margins are worked out anew from the written blocks, so that the lineage of a block stays short.
LINEAGE = 60
#: Settings of trees that are followed, and those that only say how Spark ML's own fit runs.
FOLLOWED = {"featuresCol", "labelCol", "maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "seed"} | {"cacheNodeIds", "checkpointInterval", "maxMemoryInMB"}
_NODE = "id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int"
NODES = f"treeID int, nodeData struct<{_NODE}, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
EPSILON = 2.220446049250313e-16


def whole_waves(rows: DataFrame) -> DataFrame:
    """``rows`` in equal partitions, as many as fill all cores a whole number of times; a small table of fewer partitions as it is.

    A tree fit runs hundreds of short jobs over the same partitions, so one partition too many doubles the time of each.
    """
    now, cores = rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    return rows if now < cores else rows.repartition(round(now / cores) * cores)


def large_table(rows: DataFrame, estimator: GBTClassifier | RandomForestClassifier, followed: set[str]) -> tuple[DataFrame, int] | None:
    """(x, y) of the rows and their number; None where Spark ML has to fit them: a table of one block, settings that are not
    ``followed`` here, or rows that it refuses."""
    vector, label = F.col(estimator.getFeaturesCol()), F.col(estimator.getLabelCol()).cast("double")
    named = rows.select(vector_to_array(vector).alias("x"), label.alias("y"))
    odd = F.col("x").isNull() | F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(False))
    seen = named.agg(F.count("*").alias("rows"), F.count_if(odd).alias("odd")).first()
    chosen = {p.name for p in estimator.params if estimator.isSet(p)}
    # One byte holds a bin.
    if seen["rows"] <= BLOCK_ROWS or seen["odd"] or not chosen <= followed or estimator.getMaxBins() > 256:
        return None
    return named, seen["rows"]


@dataclass
class Tree:
    """Nodes as columns, the root first. A leaf leads to itself, whatever the bin."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    count: list[float] = field(default_factory=list)
    total: list[float] = field(default_factory=list)
    square: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, count: float, total: float, square: float) -> int:
        at = len(self.feature)
        for column, value in zip((self.feature, self.cut, self.left, self.right), (0, 255, at, at)):
            column.append(value)
        for column, value in zip((self.count, self.total, self.square, self.gain), (count, total, square, -1.0)):
            column.append(value)
        return at

    def impurity(self, node: int) -> float:
        n, total, square = self.count[node], self.total[node], self.square[node]
        return (square - total * total / n) / n

    def predictions(self) -> np.ndarray:
        return np.array(self.total) / np.array(self.count)

    def square_up(self, leaves: np.ndarray) -> None:
        """Take over the squares of the leaves; a node has those of its children, which stand after it."""
        for node in reversed(range(len(self.feature))):
            left, right = self.left[node], self.right[node]
            self.square[node] = float(leaves[node]) if left == node else self.square[left] + self.square[right]

    def saved(self, cuts: Sequence[np.ndarray]) -> list[tuple]:
        """Nodes as a saved Spark ML model has them."""
        found = []
        for node, prediction in enumerate(self.predictions().tolist()):
            leaf = self.left[node] == node
            stats = [float(self.count[node]), float(self.total[node]), float(self.square[node])]
            at = (-1, -1) if leaf else (self.left[node], self.right[node])
            split = (-1, [], -1) if leaf else (self.feature[node], [float(cuts[self.feature[node]][self.cut[node]])], -1)
            found.append((node, prediction, float(self.impurity(node)), stats, int(self.count[node]), self.gain[node], *at, split))
        return found

    def routes(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut, dtype=np.uint8), np.array(self.left), np.array(self.right)


def candidate_cuts(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between the distinct values of a feature: all, or those next to equal shares of the rows."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride = len(values) / (most + 1)
    reached, target, chosen = np.cumsum(counts), stride, []
    for i, (before, after) in enumerate(zip(reached[:-1].tolist(), reached[1:].tolist())):
        if abs(before - target) < abs(after - target):
            chosen.append(i)
            target += stride
    return middles[chosen]


def all_cuts(rows: DataFrame, count: int, estimator: GBTClassifier | RandomForestClassifier) -> list[np.ndarray]:
    """Candidate cuts of each feature, from as many rows as Spark ML takes for them; every row is then binned."""
    bins = min(estimator.getMaxBins(), count)
    enough = max(estimator.getMaxBins() ** 2, 10_000)
    seen = rows if count <= enough else rows.sample(False, enough / count, estimator.getSeed())
    table = seen.select("x").toArrow()["x"].combine_chunks()  # bounded by `enough`, give or take chance
    values = table.flatten().to_numpy().reshape(len(table), -1)
    return [candidate_cuts(values[:, f], bins - 1) for f in range(values.shape[1])]


def binned(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of bins, a row of bytes for each feature, with the labels as signs."""

    def block() -> pa.RecordBatch:
        columns = [pa.array([np.ascontiguousarray(np.concatenate(part, axis=-1)).tobytes()], pa.binary()) for part in (bins, signs)]
        return pa.RecordBatch.from_arrays(columns, ["bins", "signs"])

    bins, signs, held = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
        bins.append(np.stack([np.searchsorted(c, values[:, f]).astype(np.uint8) for f, c in enumerate(cuts)]))
        signs.append(np.where(batch["y"].to_numpy() > 0, 1, -1).astype(np.int8))
        held += batch.num_rows
        if held >= block_rows:
            yield block()
            bins, signs, held = [], [], 0
    if held:
        yield block()


Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # bins, signs, margins


def _opened(row, features: int) -> Block:
    signs = np.frombuffer(row["signs"], np.int8)
    return np.frombuffer(row["bins"], np.uint8).reshape(features, -1), signs, np.zeros(len(signs))


def nodes_of(bins: np.ndarray, routes: tuple[np.ndarray, ...], levels: int, rows: np.ndarray | None = None) -> np.ndarray:
    """The node of each row, or of ``rows``, after ``levels`` steps from the root."""
    feature, cut, left, right = routes
    rows = np.arange(bins.shape[1]) if rows is None else rows
    flat, column, children = bins.ravel(), feature * bins.shape[1], np.stack([left, right], axis=1).ravel()
    node = np.zeros(len(rows), dtype=np.int64)
    for _ in range(levels):
        beyond = flat.take(column.take(node) + rows) > cut.take(node)
        node = children.take(2 * node + beyond)
    return node


def _advanced(block: Block, trees: Sequence[tuple], levels: int) -> Block:
    """The block with the weighted predictions of ``trees`` added to its margins."""
    bins, signs, margins = block
    for routes, values in trees:
        margins = margins + values.take(nodes_of(bins, routes, levels))
    return bins, signs, margins


def _residuals(signs: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """The negative gradient of the log loss 2 log(1 + exp(-2 y F))."""
    return 4.0 * signs / (1.0 + np.exp(2.0 * signs * margins))


def _histograms(block: Block, routes: tuple[np.ndarray, ...], level: int, wanted: np.ndarray, widths: Sequence[int], first: bool) -> np.ndarray:
    """One flat row: for each feature the rows and residuals of each wanted node and bin, then the squared residuals of each node."""
    bins, signs, margins = block
    residual = signs.astype(np.float64) if first else _residuals(signs, margins)  # the first tree fits the labels
    slot, kept = np.zeros(len(signs), dtype=np.int64), None
    if level:
        places = np.full(len(routes[0]), -1)
        places[wanted] = np.arange(len(wanted))
        slot = places.take(nodes_of(bins, routes, level))
        kept = np.flatnonzero(slot >= 0)
        slot, residual = slot.take(kept), residual.take(kept)
    parts = []
    for column, width in zip(bins, widths):
        cell, cells = column if kept is None else slot * width + column.take(kept), len(wanted) * width
        parts += [np.bincount(cell, minlength=cells), np.bincount(cell, residual, cells)]
    return np.concatenate([*parts, np.bincount(slot, residual * residual, len(wanted))])


def _split_up(sums: np.ndarray, nodes: int, widths: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The flat row of ``_histograms`` as (rows and residuals, node, bin) for each feature, and the squares."""
    ends = np.cumsum([2 * nodes * w for w in widths])
    *cells, squares = np.split(sums, ends)
    return [c.reshape(2, nodes, w) for c, w in zip(cells, widths)], squares


def _both(parents: np.ndarray, smaller: np.ndarray, on_left: np.ndarray) -> np.ndarray:
    """Histograms of the children, left and right in turn, from those of their parents and of the smaller child of each."""
    other = parents - smaller
    other[1][other[0] == 0] = 0.0  # nothing but rounding is left in a bin without rows
    side = on_left[None, :, None]
    pair = np.stack([np.where(side, smaller, other), np.where(side, other, smaller)], axis=2)
    return pair.reshape(2, -1, parents.shape[2])


def _best_cuts(cells: Sequence[np.ndarray], least: int, least_gain: float) -> tuple[np.ndarray, ...]:
    """(gain, feature, bin, rows and residuals to its left) of the best cut of each node, the first of equal ones; no gain, no cut."""
    nodes = np.arange(cells[0].shape[1])
    gain, feature, cut, left = np.zeros(len(nodes)), np.zeros(len(nodes), dtype=int), np.zeros(len(nodes), dtype=int), np.zeros((2, len(nodes)))
    for f, sums in enumerate(cells):
        if sums.shape[2] < 2:
            continue
        below = np.cumsum(sums, axis=2)
        (n, total), (n_left, left_sum) = below[:, :, -1:], below[:, :, :-1]
        n_right, right_sum = n - n_left, total - left_sum
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = (left_sum**2 / n_left + right_sum**2 / n_right - total**2 / n) / n
        gains = np.where((np.minimum(n_left, n_right) >= max(least, 1)) & (gains >= least_gain), gains, 0.0)
        at = gains.argmax(axis=1)
        better = gains[nodes, at] > gain
        gain, feature, cut = np.where(better, gains[nodes, at], gain), np.where(better, f, feature), np.where(better, at, cut)
        left = np.where(better, below[:, nodes, at], left)
    return gain, feature, cut, left


def _summed(state: RDD, step: Callable) -> np.ndarray:
    found = state.map(step)
    return found.reduce(np.add) if found.getNumPartitions() <= DIRECT else found.treeReduce(np.add)


@dataclass
class _Settings:
    rounds: int
    step: float
    depth: int
    least: int
    least_gain: float


def _grown(state: RDD, widths: Sequence[int], settings: _Settings, first: bool) -> Tree:
    """One regression tree on the residuals of ``state``."""
    tree, pairs, cells = Tree(), [], []
    for level in range(max(settings.depth, 1)):
        # Of two siblings the smaller one is added up; the other is what their parent has besides.
        wanted = [min(pair, key=tree.count.__getitem__) for pair in pairs] if level else [0]
        sums = _summed(state, partial(_histograms, routes=tree.routes(), level=level, wanted=np.array(wanted), widths=widths, first=first))
        found, squares = _split_up(sums, len(wanted), widths)
        if level:
            on_left = np.array([w == left for w, (left, _) in zip(wanted, pairs)])
            cells = [_both(p, s, on_left) for p, s in zip(cells, found)]
            for pair, one, square in zip(pairs, wanted, squares):
                for node in pair:  # which has its parent's until now
                    tree.square[node] = square if node == one else max(tree.square[node] - square, 0.0)
        else:
            cells = found
            tree.add(*cells[0][:, 0].sum(axis=1), squares[0])
        nodes, pairs, split = [n for pair in pairs for n in pair] or [0], [], []
        if not settings.depth:
            break
        gain, feature, cut, left = _best_cuts(cells, settings.least, settings.least_gain)
        for place, node in enumerate(nodes):
            if gain[place] > 0 and (not level or tree.impurity(node) >= EPSILON):
                split.append(place)
                tree.gain[node], tree.feature[node], tree.cut[node] = float(gain[place]), int(feature[place]), int(cut[place])
                rest = cells[tree.feature[node]][:, place].sum(axis=1) - left[:, place]
                tree.left[node], tree.right[node] = (tree.add(*side, tree.square[node]) for side in (left[:, place], rest))
                pairs.append((tree.left[node], tree.right[node]))
        if not pairs:
            break
        cells = [sums[:, split] for sums in cells]
    return tree


def _leaf_squares(block: Block, trees: Sequence[tuple], levels: int) -> np.ndarray:
    """Squared residuals of the leaf of each row, for all nodes of all trees."""
    bins, signs, margins = block
    found = []
    for number, (routes, values) in enumerate(trees):
        node, residual = nodes_of(bins, routes, levels), _residuals(signs, margins) if number else signs.astype(np.float64)
        found.append(np.bincount(node, residual * residual, len(values)))
        margins = margins + values.take(node)
    return np.concatenate(found)


def _boosted(base: RDD, widths: Sequence[int], settings: _Settings) -> list[Tree]:
    """All trees, one after the other. Blocks with their margins stay in memory or on disk of the executors."""
    trees, steps = [], []
    state, before = base, None
    for number in range(settings.rounds):
        trees.append(tree := _grown(state, widths, settings, first=not number))
        if before is not None and before is not base:
            before.unpersist()  # the first level of the tree has put `state` in its place
        steps.append((tree.routes(), (settings.step if number else 1.0) * tree.predictions()))
        whole = len(steps) % LINEAGE == 0
        advance = partial(_advanced, trees=steps[:] if whole else steps[-1:], levels=settings.depth)
        before, state = state, (base if whole else state).map(advance).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    squares = _summed(base, partial(_leaf_squares, trees=steps, levels=settings.depth))
    if before is not base:
        before.unpersist()
    for tree, found in zip(trees, np.split(squares, np.cumsum([len(t.feature) for t in trees])[:-1])):
        tree.square_up(found)
    return trees


def fit_boosted(rows: DataFrame, estimator: GBTClassifier) -> GBTClassificationModel:
    """What ``estimator.fit(rows)`` fits, ties between cuts aside, which rounding breaks there.

    The driver gets the histograms of a level, as large as the bins of all features, and decides its cuts. A table of one block
    is left to Spark ML, as are settings that are not followed here and rows it refuses.
    """
    if (large := large_table(rows, estimator, FOLLOWED | {"maxIter", "stepSize"})) is None:
        return estimator.fit(whole_waves(rows))
    named, count = large
    cuts = all_cuts(named, count, estimator)
    blocks = whole_waves(named).mapInArrow(partial(binned, cuts=cuts, block_rows=BLOCK_ROWS), "bins binary, signs binary")
    base = blocks.rdd.map(partial(_opened, features=len(cuts))).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    settings = _Settings(estimator.getMaxIter(), estimator.getStepSize(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getMinInfoGain())
    trees = _boosted(base, [len(c) + 1 for c in cuts], settings)
    base.unpersist()
    return _as_model(rows.sparkSession, estimator, trees, cuts)


def _as_model(spark: SparkSession, estimator: GBTClassifier, trees: Sequence[Tree], cuts: Sequence[np.ndarray]) -> GBTClassificationModel:
    nodes = spark.createDataFrame([(i, node) for i, tree in enumerate(trees) for node in tree.saved(cuts)], NODES)
    weights = [estimator.getStepSize() if i else 1.0 for i in range(len(trees))]
    kinds = ("classification.GBTClassificationModel", "regression.DecisionTreeRegressionModel")
    return GBTClassificationModel.load(saved_trees(nodes, estimator, kinds, weights, {"numFeatures": len(cuts)}, "variance"))


def saved_trees(nodes: DataFrame, estimator: GBTClassifier | RandomForestClassifier, kinds: tuple[str, str], weights: Sequence[float], facts: dict, impurity: str) -> str:
    """Folder of a saved Spark ML model of the class ``kinds[0]`` with trees of the class ``kinds[1]``."""
    spark, path = nodes.sparkSession, f"{scratch_root(nodes.sparkSession)}/model-{uuid.uuid4().hex}"
    chosen = {p.name: estimator.getOrDefault(p) for p in estimator.params if estimator.isSet(p)}
    shared = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "defaultParamMap": {"impurity": impurity}}
    whole = {**shared, "class": f"org.apache.spark.ml.{kinds[0]}", "uid": estimator.uid, "paramMap": chosen, **facts, "numTrees": len(weights)}
    each = {**shared, "class": f"org.apache.spark.ml.{kinds[1]}", "paramMap": {k: v for k, v in chosen.items() if k in FOLLOWED}}
    spark.range(1).select(F.lit(json.dumps(whole)).alias("value")).write.text(f"{path}/metadata")
    headers = [(i, json.dumps({**each, "uid": f"{estimator.uid}_{i}"}), w) for i, w in enumerate(weights)]
    spark.createDataFrame(headers, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes.write.parquet(f"{path}/data")
    return path
