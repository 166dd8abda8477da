"""Models behind one interface, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_stored, stored, write_apart
from .coral import Coral
from .metrics import auroc
from .splits import folds, unit_hash
from .stages import ClassWeights, ScoreColumns, Vocabulary
from .trees import ExtraTrees, HistogramBoost


def tfidf_stages(text: str, min_df: float = 5, max_df: float = 0.95, size: int = 100_000) -> list:
    """Words of two letters or more and their pairs, counted, weighted and normalised."""
    return [
        SQLTransformer(statement=f"SELECT *, translate(lower(coalesce({text}, '')), 'àâäáãçéèêëíîïñóôöõúùûü', 'aaaaaceeeeiiinoooouuuu') AS _t FROM __THIS__"),
        RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"(?U)\b\w\w+\b", gaps=False), NGram(n=2, inputCol="_w", outputCol="_p"),
        SQLTransformer(statement="SELECT *, concat(_w, _p) AS _terms FROM __THIS__"),
        Vocabulary(inputCol="_terms", outputCol="_tf", minDF=float(min_df), maxDF=float(max_df), vocabSize=size), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features"),
        SQLTransformer(statement="SELECT * EXCEPT (_t, _w, _p, _terms, _tf, _idf) FROM __THIS__"),
    ]


#: Columns of ``tfidf_stages`` before its counts.
TEXT_COLUMNS = ("_t", "_w", "_p", "_terms")


class Scorer:
    """fit, score and labels of a pyspark.ml pipeline; ``score`` adds score (of class 1) and pred. What is fitted is one PipelineModel, saved and loaded whole."""

    def __init__(self, stages: list, label: str = "y", balance: bool = True):
        self.stages, self.label, self.balance = stages, label, balance
        self.model: PipelineModel | None = None

    def pipeline(self) -> Pipeline:
        """All stages as an Estimator, for any of pyspark.ml's own tools."""
        return Pipeline(stages=[*([ClassWeights(labelCol=self.label)] if self.balance else []), *self.stages, ScoreColumns()])

    def fit(self, frame: DataFrame) -> Scorer:
        """Texts are cut into words twice: for the vocabulary, and for their counts, a written table that all later stages read."""
        frame = frame.withColumn(self.label, F.col(self.label).cast("double"))
        stages = self.pipeline().getStages()
        words = next((i for i, s in enumerate(stages, 1) if isinstance(s, Vocabulary)), 0)
        if not words:
            self.model = Pipeline(stages=stages).fit(frame)
            return self
        first = Pipeline(stages=stages[:words]).fit(frame)
        counted = first.transform(frame)
        # Words and texts are no longer needed, but later stages name the columns.
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in counted.schema if f.name in TEXT_COLUMNS]
        counts = stored(counted.select("_tf", self.label, *(["weight"] if self.balance else [])))
        rest = Pipeline(stages=stages[words:]).fit(counts.select("*", *empty))
        drop_stored(counts)
        self.model = PipelineModel(stages=first.stages + rest.stages)
        return self

    def score(self, frame: DataFrame, threshold: float = 0.5) -> DataFrame:
        if self.model is None:
            raise ValueError("the model is not fitted")
        out = self.model.transform(frame)
        return out if threshold == 0.5 else out.withColumn("pred", (F.col("score") >= threshold).cast("long"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Scorer:
        self.model = PipelineModel.load(path)
        return self


def balanced_weights(frame: DataFrame, label: str, column: str = "weight") -> DataFrame:
    """Weights that give all classes the same sum."""
    return ClassWeights(labelCol=label, weightCol=column).fit(frame).transform(frame)


def effective_number_weight(count: Column, beta: float = 0.999) -> Column:
    """Class weight by the effective number of its rows."""
    return (1 - beta) / (1 - F.pow(F.lit(beta), count))


def standardise(frame: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features minus their training mean over their training deviation (1 where that is 0), in pinned order."""
    stats = train.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    z = {f: (F.col(f) - float(stats[f"m_{f}"] or 0)) / float(stats[f"s_{f}"] or 1) for f in features}
    return frame.withColumns(z)


MODELS: dict[str, Callable[..., Scorer]] = {}


def model(name: str) -> Callable:
    def put(make: Callable[..., Scorer]) -> Callable[..., Scorer]:
        MODELS[name] = make
        return make

    return put


@model("tfidf")
def tfidf(text: str = "text", label: str = "y", **options: float) -> Scorer:
    return Scorer([*tfidf_stages(text, **options), LogisticRegression(labelCol=label, weightCol="weight", maxIter=50, regParam=1e-3)], label)


def assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


@model("gbt")
def gbt(features: Sequence[str], label: str = "y", **options: float) -> Scorer:
    return Scorer([assembled(features), GBTClassifier(labelCol=label, weightCol="weight", seed=42, **({"maxIter": 20, "maxDepth": 4} | options))], label)


@model("gbt_early")
def gbt_early(features: Sequence[str], label: str = "y", share: int = 5, **options: float) -> Scorer:
    """Boosting that stops when the loss over one in ``share`` rows, held back by a hash of their features, no longer falls."""
    names = ", ".join(f"`{f}`" for f in features)
    held_back = SQLTransformer(statement=f"SELECT *, pmod(xxhash64({names}), {share}) = 0 AS _held_back FROM __THIS__")
    boost = GBTClassifier(labelCol=label, weightCol="weight", seed=42, validationIndicatorCol="_held_back", **({"maxIter": 60, "maxDepth": 4, "validationTol": 0.001} | options))
    return Scorer([assembled(features), held_back, boost, SQLTransformer(statement="SELECT * EXCEPT (_held_back) FROM __THIS__")], label)


@model("forest")
def forest(features: Sequence[str], label: str = "y", **options: float) -> Scorer:
    return Scorer([assembled(features), RandomForestClassifier(labelCol=label, weightCol="weight", seed=42, **({"numTrees": 50, "maxDepth": 6} | options))], label)


@model("elastic")
def elastic(features: Sequence[str], label: str = "y", mix: float = 0.3, penalty: float = 1e-3, rounds: int = 100) -> Scorer:
    return Scorer([assembled(features), LogisticRegression(labelCol=label, weightCol="weight", elasticNetParam=mix, regParam=penalty, maxIter=rounds)], label)


@model("svm")
def svm(features: Sequence[str], label: str = "y") -> Scorer:
    return Scorer([assembled(features), LinearSVC(labelCol=label, weightCol="weight", maxIter=50, regParam=1e-3)], label)


@model("extra_trees")
def extra_trees(features: Sequence[str], label: str = "y", **options: float) -> Scorer:
    return Scorer([assembled(features), ExtraTrees(labelCol=label, **options)], label)


@model("hist_gbm")
def hist_gbm(features: Sequence[str], label: str = "y", **options: float) -> Scorer:
    return Scorer([assembled(features), HistogramBoost(labelCol=label, **options)], label)


@model("multinomial")
def multinomial(text: str = "text", label: str = "y", rounds: int = 30, **options: float) -> Scorer:
    """Classes from 0 on; ``score`` is the probability of class 1, ``prediction`` the class. Its weights are terms times classes: keep ``size`` to what the driver holds."""
    return Scorer([*tfidf_stages(text, **options), LogisticRegression(labelCol=label, weightCol="weight", family="multinomial", maxIter=rounds, regParam=1e-3)], label)


def community_classes(frame: DataFrame, community: str) -> DataFrame:
    """Adds y: the place of the community's name among all, from 0. Names are as many as classes of a model."""
    names = sorted(r[0] for r in frame.where(F.col(community).isNotNull()).select(community).distinct().collect())
    number = F.map_from_arrays(F.lit(names), F.lit(list(range(len(names)))))
    return frame.where(F.col(community).isNotNull()).withColumn("y", F.element_at(number, F.col(community)).cast("double"))


def build_model(name: str, **options: object) -> Scorer:
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name](**options)


def out_of_fold(frame: DataFrame, make: Callable[[], Scorer], key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Scores of each row by a model that did not see its fold."""
    marked = folds(frame, key, k, seed)
    parts = [make().fit(marked.where(F.col("fold") != i)).score(marked.where(F.col("fold") == i)) for i in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nested_grid(frame: DataFrame, make: Callable[..., Scorer], grid: Sequence[dict], key: str, label: str = "y", outer: int = 5, inner: int = 3, seed: int = 42, workers: int = 4) -> DataFrame:
    """(columns of ``frame``, fold, chosen, score, pred): each row scored by a model that did not see its outer fold.

    ``chosen`` is the place in ``grid`` of that model's options: those of greatest AUROC (the first of equal ones) over
    inner folds of the rows outside the outer fold alone. The rows and all their folds are one written table, held in
    memory for the fits, of which ``workers`` run at a time; one job over all inner scores gives every AUROC.

    Fits run in a session of their own: a session that has used an Observation can't serialise the closures of later fits.
    """
    spark = frame.sparkSession
    apart = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):  # the session's own settings; the rest is the cluster's
        if (value := spark.conf.get(name, None)) is not None:
            apart.conf.set(name, value)
    place = lambda k, s: F.floor(unit_hash(F.col(key), s) * k).cast("long")
    marked = frame.withColumns({"fold": place(outer, seed)} | {f"_inner{i}": place(inner, seed + 1 + i) for i in range(outer)})
    path = write_apart(marked)
    rows = apart.read.schema(marked.schema).parquet(path).persist()

    def inner_scores(case: tuple[int, int, int]) -> DataFrame:
        i, option, j = case
        fitted = make(**grid[option]).fit(rows.where((F.col("fold") != i) & (F.col(f"_inner{i}") != j)))
        scored = fitted.score(rows.where((F.col("fold") != i) & (F.col(f"_inner{i}") == j)))
        return scored.select(F.lit(i).alias("_fold"), F.lit(option).alias("_option"), F.col(label).cast("long").alias("_y"), "score")

    def outer_scores(case: tuple[int, int]) -> DataFrame:
        i, option = case
        fitted = make(**grid[option]).fit(rows.where(F.col("fold") != i))
        return fitted.score(rows.where(F.col("fold") == i)).withColumn("chosen", F.lit(option).cast("long")).select(*frame.columns, "fold", "chosen", "score", "pred")

    try:
        with ThreadPoolExecutor(workers) as pool:
            tried = list(pool.map(inherited(apart, inner_scores), [(i, option, j) for i in range(outer) for option in range(len(grid)) for j in range(inner)])) if len(grid) > 1 else []
            found = {(r._fold, r._option): r.auroc or 0.0 for r in auroc(reduce(DataFrame.union, tried), "_y", "score", ("_fold", "_option")).collect()} if tried else {}
            chosen = {i: max(range(len(grid)), key=lambda at, i=i: (found.get((i, at), 0.0), -at)) for i in range(outer)}
            parts = list(pool.map(inherited(apart, outer_scores), chosen.items()))
        done = reduce(DataFrame.union, parts)
        scores = write_apart(done)
    finally:
        rows.unpersist()
    return spark.read.schema(done.schema).parquet(scores)


def inherited(spark: SparkSession, function: Callable) -> Callable:
    """The function with the caller's job group and tags in a thread of a pool."""
    wrapped = inheritable_thread_target(spark)
    return wrapped(function)


def stacked(frame: DataFrame, makers: dict[str, Callable[[], Scorer]], key: str, label: str = "y", k: int = 3) -> tuple[Scorer, DataFrame]:
    """A logistic regression over the out-of-fold scores of base models."""
    wide = frame
    for name, make in makers.items():
        wide = wide.join(out_of_fold(frame, make, key, k).select(key, F.col("score").alias(f"s_{name}")), key)
    meta = elastic([f"s_{n}" for n in makers], label, 0.0).fit(wide)
    return meta, meta.score(wide)


def ordinal(frame: DataFrame, features: Sequence[str], label: str, levels: int, rounds: int = 60) -> DataFrame:
    """Adds levels_above and level by one weight vector and ordered thresholds (``coral.Coral``)."""
    fitted = Pipeline(stages=[assembled(features), Coral(labelCol=label, levels=levels, maxIter=rounds)]).fit(frame)
    return fitted.transform(frame).drop("features")


def top_terms(scorer: Scorer, n: int = 20) -> list[tuple[str, float]]:
    """Terms of the greatest and least coefficients (the vocabulary has a bound)."""
    vocabulary = next(s.vocabulary for s in scorer.model.stages if hasattr(s, "vocabulary"))
    weights = list(zip(vocabulary, next(s for s in scorer.model.stages if hasattr(s, "coefficients")).coefficients.toArray().tolist(), strict=True))
    weights.sort(key=lambda w: (-w[1], w[0]))
    return weights[:n] + weights[-n:]


def permutation_importances(frame: DataFrame, scorer: Scorer, key: str, columns: Sequence[str], label: str = "y", seed: int = 42) -> DataFrame:
    """(feature, loss): loss of accuracy when a column is moved to other rows, for each column in one job.

    Each row takes the value of the next row by hash within its one of 64 buckets (the last one that of the first).
    """
    own = Window.partitionBy("_b").orderBy("_u", key)
    dealt = frame.withColumn("_u", unit_hash(F.col(key), seed)).withColumn("_b", F.floor(F.col("_u") * 64))
    right = lambda f, name: scorer.score(f).select(F.lit(name).alias("feature"), (F.col("pred") == F.col(label)).cast("double").alias("right"))
    mixed = [right(dealt.withColumn(c, F.coalesce(F.lead(c).over(own), F.first(c).over(own))).drop("_u", "_b"), c) for c in columns]
    whole = right(frame, "").agg(F.avg("right").alias("whole"))
    return reduce(DataFrame.union, mixed).groupBy("feature").agg(F.avg("right").alias("right")).join(F.broadcast(whole)).select("feature", (F.col("whole") - F.col("right")).alias("loss"))  # one row


def permutation_importance(frame: DataFrame, scorer: Scorer, key: str, column: str, label: str = "y", seed: int = 42) -> float:
    """The loss of accuracy of one column."""
    return permutation_importances(frame, scorer, key, [column], label, seed).first()["loss"]
