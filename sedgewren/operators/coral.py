"""Ordinal regression with one weight vector and ordered thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thresholds_of(raw: np.ndarray) -> np.ndarray:
    """Falling thresholds: the first as it is, each further one lower by the exponential of its number."""
    return raw[0] - np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def partial_sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its rows' loss and the loss's slopes by weight and threshold."""
    total = np.zeros(1 + len(weights) + len(bounds))
    ranks = np.arange(1, len(bounds) + 1)
    for batch in batches:
        x = np.asarray(batch["x"].flatten()).reshape(batch.num_rows, len(weights))
        above = (np.asarray(batch["y"])[:, None] >= ranks[None, :]).astype(float)
        z = (x @ weights)[:, None] + bounds[None, :]
        off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - above
        total[0] += float((np.logaddexp(0, z) - above * z).sum())
        total[1 : 1 + len(weights)] += off.sum(axis=1) @ x
        total[1 + len(weights) :] += off.sum(axis=0)
    yield pa.RecordBatch.from_pydict({"g": pa.array([total.tolist()], pa.list_(pa.float64()))})


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, rounds: int, tolerance: float = 1e-7) -> np.ndarray:
    """Quasi-Newton steps (BFGS) with halved lengths until the loss falls enough; the state is as small as the model."""
    value, slope = loss(at)
    inverse = np.eye(len(at))
    for _ in range(rounds):
        way = -inverse @ slope
        if way @ slope >= 0:
            inverse, way = np.eye(len(at)), -slope
        length, found = 1.0, None
        while length > 1e-10:
            new_value, new_slope = loss(at + length * way)
            if new_value <= value + 1e-4 * length * (way @ slope):
                found = (new_value, new_slope)
                break
            length /= 2
        if found is None:
            return at
        step, change = length * way, found[1] - slope
        at, before = at + step, value
        value, slope = found
        if abs(before - value) <= tolerance * max(1.0, abs(value)) and np.abs(slope).max() < 1e-4:
            return at
        if (curve := step @ change) > 1e-12:
            left = np.eye(len(at)) - np.outer(step, change) / curve
            inverse = left @ inverse @ left.T + np.outer(step, step) / curve
    return at


class Coral(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasRegParam, DefaultParamsReadable, DefaultParamsWritable):
    """Consistent ranks: P(y >= j) is the logistic of one weighted sum plus a threshold that falls with j.

    Thresholds are ordered by their parameters, so the probabilities of higher levels never exceed those of lower
    ones. Each evaluation is one pass: a partition sums its loss and slopes in numpy, Spark adds up
    the partitions' rows; the driver holds a vector of the model's size. Rows with a null label are left out, null features count as 0.
    Labels are whole numbers from 0 to levels - 1. Features are scaled to unit deviation within the fit.
    """

    levels = Param(Params._dummy(), "levels", "number of levels", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "y", levels: int = 3, maxIter: int = 60, regParam: float = 1e-3):  # noqa: N803
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="y", levels=3, maxIter=60, regParam=1e-3)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CoralModel:
        steps = self.getOrDefault(self.levels) - 1
        vector = F.transform(vector_to_array(self.getFeaturesCol()), lambda v: F.when(F.isnan(v), 0.0).otherwise(v))
        rows = dataset.where(F.col(self.getLabelCol()).isNotNull()).select(vector.alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).persist()
        try:
            first = rows.first()
            if first is None or steps < 1:
                raise ValueError("an ordinal model needs rows and at least two levels")
            size = len(first["x"])
            moments = [m(F.get("x", i)) for i in range(size) for m in (F.avg, F.stddev_pop)]
            found = rows.agg(F.count("*"), *moments).first()
            count, mean, deviation = found[0], np.array(found[1::2], float), np.array([d or 1.0 for d in found[2::2]], float)
            scaled = rows.select(F.transform("x", lambda v, i: (v - F.get(F.lit(mean.tolist()), i)) / F.get(F.lit(deviation.tolist()), i)).alias("x"), "y")
            penalty = self.getRegParam()

            def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
                weights, bounds = at[:size], thresholds_of(at[size:])
                parts = scaled.mapInArrow(lambda batches: partial_sums(batches, weights, bounds), "g array<double>")
                sums = np.array(parts.agg(*[F.sum(F.get("g", i)) for i in range(1 + size + steps)]).first(), float) / count
                by_bound = sums[1 + size :]
                # The j-th number moves all thresholds from the j-th on.
                rest = np.cumsum(by_bound[::-1])[::-1]
                slope = np.concatenate([sums[1 : 1 + size] + penalty * weights, [rest[0]], -np.exp(at[size + 1 :]) * rest[1:]])
                return float(sums[0] + penalty / 2 * (weights @ weights)), slope

            at = descend(loss, np.zeros(size + steps), self.getMaxIter())
        finally:
            rows.unpersist()
        weights = at[:size] / deviation
        bounds = thresholds_of(at[size:]) - mean @ weights
        return CoralModel(featuresCol=self.getFeaturesCol(), weights=weights.tolist(), thresholds=bounds.tolist())


class CoralModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds levels_above (P(y >= j) for j = 1, 2, ...) and level: how many of them reach a half. All in built-in functions."""

    weights = Param(Params._dummy(), "weights", "a weight for each feature", typeConverter=TypeConverters.toListFloat)
    thresholds = Param(Params._dummy(), "thresholds", "falling thresholds", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", weights: list[float] | None = None, thresholds: list[float] | None = None):  # noqa: N803
        super().__init__()
        self._setDefault(featuresCol="features", weights=[], thresholds=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = F.transform(vector_to_array(self.getFeaturesCol()), lambda v: F.when(F.isnan(v), 0.0).otherwise(v))
        score = F.aggregate(F.zip_with(x, F.lit(self.getOrDefault(self.weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        above = F.transform(F.lit(self.getOrDefault(self.thresholds)), lambda t: 1 / (1 + F.exp(-(score + t))))
        wide = dataset.withColumn("levels_above", above)
        return wide.withColumn("level", F.size(F.filter("levels_above", lambda p: p >= 0.5)).cast("long"))
