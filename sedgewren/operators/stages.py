"""Stages of pyspark.ml pipelines that the library adds; each is saved and loaded with its pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stored, stored


class ClassWeights(Estimator, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns weights that give all classes the same sum; a weight column that is there already is multiplied."""

    @keyword_only
    def __init__(self, *, labelCol: str = "y", weightCol: str = "weight"):  # noqa: N803 (pyspark's names)
        super().__init__()
        self._setDefault(labelCol="y", weightCol="weight")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ClassWeightsModel:
        sizes = {float(r[0]): r[1] for r in dataset.groupBy(F.col(self.getLabelCol()).cast("double")).count().collect() if r[0] is not None}
        total = sum(sizes.values())
        classes = sorted(sizes)
        return ClassWeightsModel(labelCol=self.getLabelCol(), weightCol=self.getWeightCol(), classes=classes, weights=[total / (len(sizes) * sizes[c]) for c in classes])


class ClassWeightsModel(Model, HasLabelCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the weight of each row's class: 1 for classes it does not know and for rows without the label column."""

    classes = Param(Params._dummy(), "classes", "labels, ascending", typeConverter=TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "the weight of each label", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, labelCol: str = "y", weightCol: str = "weight", classes: list[float] | None = None, weights: list[float] | None = None):  # noqa: N803
        super().__init__()
        self._setDefault(labelCol="y", weightCol="weight", classes=[], weights=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, weight = self.getWeightCol(), F.lit(1.0)
        if self.getLabelCol() in dataset.columns:
            for value, share in zip(self.getOrDefault(self.classes), self.getOrDefault(self.weights), strict=True):
                weight = F.when(F.col(self.getLabelCol()).cast("double") == value, share).otherwise(weight)
        return dataset.withColumn(name, F.col(name) * weight if name in dataset.columns else weight)


class Vocabulary(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the ``vocabSize`` most frequent terms of an array column as a CountVectorizerModel (its own estimator holds the terms of all rows in memory).

    ``minDF`` and ``maxDF`` bound a term's rows: numbers from 1 on, shares below. Of equally frequent terms the first in order are taken.
    """

    minDF = Param(Params._dummy(), "minDF", "least rows of a term, or share of them", typeConverter=TypeConverters.toFloat)
    maxDF = Param(Params._dummy(), "maxDF", "most rows of a term, or share of them", typeConverter=TypeConverters.toFloat)
    vocabSize = Param(Params._dummy(), "vocabSize", "most terms", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "terms", outputCol: str = "counts", minDF: float = 1.0, maxDF: float = 1.0, vocabSize: int = 1 << 18):  # noqa: N803
        super().__init__()
        self._setDefault(minDF=1.0, maxDF=float((1 << 63) - 1), vocabSize=1 << 18)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        # Two rows a text, all its terms and the distinct ones: one reading of the texts counts both, and also the texts (null).
        forms = F.array(F.struct(F.array_append("_t", F.lit(None)).alias("t"), F.lit(1).alias("all"), F.lit(0).alias("rows")), F.struct(F.array_distinct("_t").alias("t"), F.lit(0).alias("all"), F.lit(1).alias("rows")))
        terms = dataset.select(F.explode(F.array(F.coalesce(F.col(self.getInputCol()), F.array().cast("array<string>")))).alias("_t")).select(F.inline(forms))
        counts = stored(terms.select("all", "rows", F.explode("t").alias("term")).groupBy("term").agg(F.sum("all").alias("n"), F.sum("rows").alias("rows")))
        total = counts.where("term is null").agg(F.sum("n")).first()[0] or 0
        least, most = (v if v >= 1 else v * total for v in (self.getOrDefault(self.minDF), self.getOrDefault(self.maxDF)))
        kept = counts.where(F.col("term").isNotNull() & (F.col("rows") >= least) & (F.col("rows") <= most))
        found = [r.term for r in kept.orderBy(F.col("n").desc(), "term").select("term").limit(self.getOrDefault(self.vocabSize)).collect()]  # a model's terms
        drop_stored(counts)
        return CountVectorizerModel.from_vocabulary(found, inputCol=self.getInputCol(), outputCol=self.getOutputCol())


class ScoreColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds score, the probability of class 1 (or the logistic of the raw prediction where there is none), and pred."""

    threshold = Param(Params._dummy(), "threshold", "least score of class 1", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, threshold: float = 0.5):
        super().__init__()
        self._setDefault(threshold=0.5)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if "probability" in dataset.columns:
            score = F.get(vector_to_array("probability"), 1)
        else:
            score = 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), 1)))
        return dataset.withColumn("score", score).withColumn("pred", (F.col("score") >= self.getOrDefault(self.threshold)).cast("long"))
