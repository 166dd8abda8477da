"""Trees grown level by level over histograms that Spark sums: extremely randomised trees and second-order boosting."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stored, stored

#: Bins of a feature, cut at approximate quantiles.
BINS = 64
#: Histogram cells that one pass sums up and the driver gets; trees are grown in groups that keep to it.
CELLS = 1_000_000


class Tree:
    """Nodes in lists: feature (-1 in a leaf), bin up to which rows go left, children, and value."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        for row, new in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            row += [new, new]
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, len(self.value) - 2, len(self.value) - 1
        return self.left[node], self.right[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(a) for a in (self.feature, self.cut, self.left, self.right, self.value))


def route(bins: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node that each row ends in."""
    feature, cut, left, right, _ = tree
    nodes = np.zeros(len(bins), dtype=np.int64)
    while True:
        inner = np.flatnonzero(feature[nodes] >= 0)
        if not len(inner):
            return nodes
        at = nodes[inner]
        nodes[inner] = np.where(bins[inner, feature[at]] <= cut[at], left[at], right[at])


def binned(matrix: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin numbers: how many edges of its feature a value exceeds. Not-a-number counts as 0."""
    clean = np.nan_to_num(matrix, nan=0.0, posinf=np.inf, neginf=-np.inf)
    return np.stack([np.searchsorted(np.asarray(e, float), clean[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8) if len(edges) else np.zeros((len(matrix), 0), np.uint8)


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().fill_null(float("nan")), float).reshape(len(column), size)


def edges_of(rows: DataFrame, size: int) -> list[list[float]]:
    """Inner edges of each feature's bins: its distinct approximate quantiles, in one pass."""
    shares = F.expr("array(" + ", ".join(f"{i / BINS}D" for i in range(1, BINS)) + ")")
    value = lambda i: F.when(F.isnan(F.get("x", i)), 0.0).otherwise(F.get("x", i))
    found = rows.agg(*[F.percentile_approx(value(i), shares, 100 * BINS) for i in range(size)]).first()
    return [sorted(set(cuts or [])) for cuts in found]


Moments = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def histograms(rows: DataFrame, trees: list[Tree], active: list[list[int]], slots: list[dict[int, np.ndarray]], width: int, moments: Moments) -> np.ndarray:
    """Sums of (count, first, second moment) by tree, active node, feature slot and bin: a partition sums its rows, Spark the partitions."""
    shape = (len(trees), max(map(len, active)), width, BINS)
    plain = [t.arrays() for t in trees]
    places = []
    for tree, nodes in zip(trees, active, strict=True):
        place = np.full(len(tree.value), -1)
        place[nodes] = range(len(nodes))
        places.append(place)
    chosen = [np.stack([own[n] for n in nodes]) if nodes else np.zeros((0, width), int) for own, nodes in zip(slots, active, strict=True)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, int(np.prod(shape))))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.frombuffer(b"".join(batch["b"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            first, second = moments(np.asarray(batch["y"], float), np.asarray(batch["w"], float), np.asarray(batch["m"], float))
            for t, tree in enumerate(plain):
                place = places[t][route(bins, tree)]
                kept = np.flatnonzero(place >= 0)
                for slot in range(width if len(kept) else 0):
                    feature = chosen[t][place[kept], slot]
                    cell = ((t * shape[1] + place[kept]) * width + slot) * BINS + bins[kept, feature]
                    for k, values in enumerate((None, first[kept], second[kept])):
                        total[k] += np.bincount(cell, values, minlength=total.shape[1])
        there = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"cell": pa.array(there, pa.int64()), "n": total[0][there], "g": total[1][there], "h": total[2][there]})

    found = rows.mapInArrow(sums, "cell long, n double, g double, h double").groupBy("cell").agg(F.sum("n"), F.sum("g"), F.sum("h")).toPandas().to_numpy(float)
    out = np.zeros((3, int(np.prod(shape))))
    if len(found):
        out[:, found[:, 0].astype(int)] = found[:, 1:].T
    return out.reshape(3, *shape)


class TreeParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", typeConverter=TypeConverters.toInt)  # noqa: N815 (pyspark's name)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below the root", typeConverter=TypeConverters.toInt)  # noqa: N815
    minLeaf = Param(Params._dummy(), "minLeaf", "least rows of a leaf", typeConverter=TypeConverters.toInt)  # noqa: N815


class TreeEstimator(Estimator, TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """What both kinds share: bins once, a written table of binned rows that every pass reads from memory, and the model."""

    def prepare(self, dataset: DataFrame) -> tuple[DataFrame, list[list[float]]]:
        label, weight = F.col(self.getLabelCol()), self.getWeightCol()
        rows = dataset.where(label.isNotNull()).select(vector_to_array(self.getFeaturesCol()).alias("x"), label.cast("double").alias("y"), (F.col(weight).cast("double") if weight in dataset.columns else F.lit(1.0)).alias("w"))
        first = rows.first()
        if first is None:
            raise ValueError("a tree needs rows")
        size = len(first["x"])
        edges = edges_of(rows, size)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = binned(matrix_of(batch["x"], size), edges)
                yield pa.RecordBatch.from_pydict({"b": pa.array([row.tobytes() for row in bins], pa.binary()), "y": batch["y"], "w": batch["w"]})

        return rows.mapInArrow(pack, "b binary, y double, w double"), edges


class TreeModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds probability: the mean of the trees' values, or the logistic of their sum where ``boosted``."""

    edges = Param(Params._dummy(), "edges", "inner edges of each feature's bins, as JSON", typeConverter=TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "nodes of each tree, as JSON", typeConverter=TypeConverters.toString)
    start = Param(Params._dummy(), "start", "what boosting starts from", typeConverter=TypeConverters.toFloat)
    boosted = Param(Params._dummy(), "boosted", "whether values are added up", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", edges: str = "[]", trees: str = "[]", start: float = 0.0, boosted: bool = False):  # noqa: N803
        super().__init__()
        self._setDefault(featuresCol="features", edges="[]", trees="[]", start=0.0, boosted=False)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, plain, start, boosted = json.loads(self.getOrDefault(self.edges)), self.getOrDefault(self.trees), self.getOrDefault(self.start), self.getOrDefault(self.boosted)

        @F.pandas_udf("double")
        def probability(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=float)
            trees = [tuple(map(np.array, t)) for t in json.loads(plain)]
            bins = binned(np.stack([np.asarray(r, float) for r in rows]), edges)
            total = np.full(len(bins), start) + sum((t[4][route(bins, t)] for t in trees), np.zeros(len(bins)))
            return pd.Series(1 / (1 + np.exp(-total)) if boosted else total / max(1, len(trees)))

        scored = dataset.withColumn("_p", probability(vector_to_array(self.getFeaturesCol())))
        return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")


class ExtraTrees(TreeEstimator):
    """Extremely randomised trees: a node looks at sqrt(features) of them, at one random cut of each, and takes the purest.

    All trees of a group grow one level in one pass. Cuts fall between bins. A leaf's value is its weighted share of
    class 1. Each tree sees all rows. The model has at most numTrees * 2^maxDepth leaves.
    """

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "y", weightCol: str = "weight", numTrees: int = 50, maxDepth: int = 6, minLeaf: int = 3, seed: int = 42):  # noqa: N803
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="y", weightCol="weight", numTrees=50, maxDepth=6, minLeaf=3, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TreeModel:
        packed, edges = self.prepare(dataset)
        rows = stored(packed.withColumn("m", F.lit(0.0)))
        held = rows.persist()
        try:
            width = max(1, round(len(edges) ** 0.5))
            depth, number = self.getOrDefault(self.maxDepth), self.getOrDefault(self.numTrees)
            group = max(1, CELLS // (2 ** max(0, depth - 1) * width * BINS))
            trees: list[Tree] = []
            for begin in range(0, number, group):
                trees += self.grow(held, edges, range(begin, min(number, begin + group)), width, depth)
        finally:
            held.unpersist()
            drop_stored(rows)
        return TreeModel(featuresCol=self.getFeaturesCol(), edges=json.dumps(edges), trees=json.dumps([[a.tolist() for a in t.arrays()] for t in trees]))

    def grow(self, rows: DataFrame, edges: list[list[float]], numbers: Sequence[int], width: int, depth: int) -> list[Tree]:
        least, seed = self.getOrDefault(self.minLeaf), self.getSeed()
        trees, active = [Tree() for _ in numbers], [[0] for _ in numbers]
        share = lambda part, whole: min(1.0, max(0.0, float(part / whole)))
        for level in range(depth):
            if not any(active):
                break
            slots = [{n: np.random.default_rng([seed, number, n]).choice(len(edges), width, replace=False) for n in nodes} for number, nodes in zip(numbers, active, strict=True)]
            count, weight, ones = histograms(rows, trees, active, slots, width, lambda y, w, m: (w, w * y))
            for t, (number, tree) in enumerate(zip(numbers, trees, strict=True)):
                following = []
                for a, node in enumerate(active[t]):
                    whole, positive = weight[t, a, 0].sum(), ones[t, a, 0].sum()
                    tree.value[node] = share(positive, whole) if whole else 0.0
                    if positive <= 0 or positive >= whole:
                        continue
                    draw, best = np.random.default_rng([seed, number, node, 1]), None
                    for slot, feature in enumerate(slots[t][node]):
                        there = np.flatnonzero(count[t, a, slot])
                        if there[0] == there[-1]:
                            continue
                        cut = int(draw.integers(there[0], there[-1]))
                        n, w, p = (float(x[t, a, slot, : cut + 1].sum()) for x in (count, weight, ones))
                        if min(n, count[t, a, slot].sum() - n) < least or min(w, whole - w) <= 0:
                            continue
                        impurity = p * (1 - p / w) + (positive - p) * (1 - (positive - p) / (whole - w))
                        if best is None or impurity < best[0]:
                            best = (impurity, int(feature), cut, share(p, w), share(positive - p, whole - w))
                    if best is not None:
                        left, right = tree.split(node, best[1], best[2])
                        tree.value[left], tree.value[right] = best[3], best[4]
                        following += [left, right]
                active[t] = following if level + 1 < depth else []
        return trees


class HistogramBoost(TreeEstimator):
    """Gradient boosting with second-order leaves: each level of each tree is one pass of slopes and curvatures by node, feature and bin.

    A row's margin is its stored one plus the trees since; it is stored anew every ``KEEP`` trees, so a pass does not
    walk all trees before.
    """

    KEEP = 10

    stepSize = Param(Params._dummy(), "stepSize", "what a tree's values are multiplied by", typeConverter=TypeConverters.toFloat)  # noqa: N815
    penalty = Param(Params._dummy(), "penalty", "added to a leaf's curvature", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "y", weightCol: str = "weight", numTrees: int = 20, maxDepth: int = 3, minLeaf: int = 3, stepSize: float = 0.1, penalty: float = 1.0, seed: int = 42):  # noqa: N803
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="y", weightCol="weight", numTrees=20, maxDepth=3, minLeaf=3, stepSize=0.1, penalty=1.0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TreeModel:
        packed, edges = self.prepare(dataset)
        shares = packed.agg(F.sum("w"), F.sum(F.col("w") * F.col("y"))).first()
        share = min(max(shares[1] / shares[0], 1e-6), 1 - 1e-6) if shares[0] else 0.5
        start = float(np.log(share / (1 - share)))
        rows = stored(packed.withColumn("m", F.lit(start)))
        held, trees, pending = rows.persist(), [], []
        try:
            for _ in range(self.getOrDefault(self.numTrees)):
                pending.append(self.grow(held, len(edges), pending))
                trees.append(pending[-1])
                if len(pending) == self.KEEP:
                    moved = stored(add_margins(held, pending))
                    held.unpersist()
                    drop_stored(rows)
                    rows, pending = moved, []
                    held = rows.persist()
        finally:
            held.unpersist()
            drop_stored(rows)
        return TreeModel(featuresCol=self.getFeaturesCol(), edges=json.dumps(edges), trees=json.dumps([[a.tolist() for a in t.arrays()] for t in trees]), start=start, boosted=True)

    def grow(self, rows: DataFrame, size: int, pending: list[Tree]) -> Tree:
        least, step, penalty = self.getOrDefault(self.minLeaf), self.getOrDefault(self.stepSize), self.getOrDefault(self.penalty)
        tree, active, every = Tree(), [0], np.arange(size)
        current = add_margins(rows, pending) if pending else rows

        def slopes(y: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-m))
            return w * (p - y), w * p * (1 - p)

        leaf = lambda g, h: -step * float(g / (h + penalty))
        for _ in range(self.getOrDefault(self.maxDepth)):
            if not active:
                break
            count, slope, bend = (x[0] for x in histograms(current, [tree], [active], [dict.fromkeys(active, every)], size, slopes))
            following = []
            for a, node in enumerate(active):
                n, g, h = (np.cumsum(x[a], axis=1) for x in (count, slope, bend))
                whole_n, whole_g, whole_h = n[0, -1], g[0, -1], h[0, -1]
                tree.value[node] = leaf(whole_g, whole_h)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = g**2 / (h + penalty) + (whole_g - g) ** 2 / (whole_h - h + penalty) - whole_g**2 / (whole_h + penalty)
                gain = np.where((n >= least) & (whole_n - n >= least), gain, -np.inf)
                feature, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[feature, cut] <= 1e-9:
                    continue
                left, right = tree.split(node, int(feature), int(cut))
                tree.value[left], tree.value[right] = leaf(g[feature, cut], h[feature, cut]), leaf(whole_g - g[feature, cut], whole_h - h[feature, cut])
                following += [left, right]
            active = following
        return tree


def add_margins(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """The binned rows with the trees' values added to their margins."""
    plain = [t.arrays() for t in trees]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.asarray(batch["m"], float).copy()
            if batch.num_rows:
                bins = np.frombuffer(b"".join(batch["b"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for tree in plain:
                    margins += tree[4][route(bins, tree)]
            yield pa.RecordBatch.from_pydict({"b": batch["b"], "y": batch["y"], "w": batch["w"], "m": pa.array(margins)})

    return rows.mapInArrow(add, "b binary, y double, w double, m double")
