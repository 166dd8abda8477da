"""Models that the library adds: ordinal ranks, trees over histograms, saved pipelines."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.sql import functions as F

from sedgewren.operators import metrics, models, trees
from sedgewren.operators.coral import Coral, descend, thresholds_of
from sedgewren.operators.stages import Vocabulary


def ordered_rows(n=240):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2)) * [1.0, 30.0] + [0.0, 100.0]
    z = 1.5 * x[:, 0] - 0.02 * (x[:, 1] - 100) + rng.logistic(size=n)
    return [(i, float(a), float(b), int(v > -1) + int(v > 0.5) + int(v > 2)) for i, ((a, b), v) in enumerate(zip(x, z, strict=True))]


def plain_coral(rows, levels, penalty):
    """The same loss in one piece, minimised by small steps along its slope."""
    x = np.array([r[1:3] for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    above = np.array([[r[3] >= j for j in range(1, levels)] for r in rows], float)
    w, b = np.zeros(2), np.linspace(0.5, -0.5, levels - 1)
    for _ in range(6000):
        off = 1 / (1 + np.exp(-((x @ w)[:, None] + b))) - above
        w -= 0.3 * (off.sum(axis=1) @ x / len(x) + penalty * w)
        b -= 0.3 * off.sum(axis=0) / len(x)
    return 1 / (1 + np.exp(-((x @ w)[:, None] + b)))


def test_coral_equals_a_plain_optimiser(spark):
    rows = ordered_rows()
    frame = spark.createDataFrame(rows, "id long, a double, b double, lv long")
    fitted = models.ordinal(frame, ["a", "b"], "lv", 4)
    assert fitted.columns == ["id", "a", "b", "lv", "levels_above", "level"]
    got = {r.id: r for r in fitted.collect()}
    want = plain_coral(rows, 4, 1e-3)
    assert np.abs(np.array([got[i].levels_above for i in range(len(rows))]) - want).max() < 2e-3
    assert all(r.levels_above == sorted(r.levels_above, reverse=True) and r.level == sum(p >= 0.5 for p in r.levels_above) for r in got.values())
    assert sum(abs(r.level - r.lv) <= 1 for r in got.values()) >= 0.9 * len(rows)


def test_coral_thresholds_fall_and_gaps_are_allowed(spark):
    assert (np.diff(thresholds_of(np.array([1.0, -50.0, 0.0, 3.0]))) <= 0).all()
    frame = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 3), (4.0, 3), (None, None), (float("nan"), 1)], "a double, lv int")  # no row of level 2
    got = models.ordinal(frame, ["a"], "lv", 4, rounds=30)
    assert got.count() == 6 and all(np.diff(r.levels_above).max() <= 0 for r in got.collect())
    with pytest.raises(ValueError):
        models.ordinal(frame.limit(0), ["a"], "lv", 4)


def test_descend_finds_a_quadratic_minimum():
    matrix, goal = np.array([[3.0, 1.0], [1.0, 2.0]]), np.array([1.0, -4.0])
    assert np.allclose(descend(lambda v: (float((v - goal) @ matrix @ (v - goal)), 2 * matrix @ (v - goal)), np.zeros(2), 50, 0.0), goal, atol=1e-3)


def tree_rows(spark, n=400):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    return x, y, spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y long").repartition(5)


def plain_boost(bins, y, rounds, depth, step, penalty, least):
    """Boosting by recursion over all rows at once."""
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))

    def grow(at, level, g, h):
        value = -step * g[at].sum() / (h[at].sum() + penalty)
        best = (1e-9, None)
        for feature in range(bins.shape[1] if level < depth else 0):
            for cut in range(trees.BINS):
                left = at[bins[at, feature] <= cut]
                if len(left) < least or len(at) - len(left) < least:
                    continue
                right = np.setdiff1d(at, left)
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + penalty)
                if gain > best[0] + 1e-9:
                    best = (gain, (left, right))
        if best[1] is None:
            margin[at] += value
        else:
            for side in best[1]:
                grow(side, level + 1, g, h)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), 0, p - y, p * (1 - p))
    return 1 / (1 + np.exp(-margin))


def test_boosting_equals_plain_recursion(spark, monkeypatch):
    monkeypatch.setattr(trees.HistogramBoost, "KEEP", 2)
    monkeypatch.setattr(trees, "BINS", 8)
    x, y, frame = tree_rows(spark, 200)
    scorer = models.Scorer(models.hist_gbm(["a", "b", "c", "d"], numTrees=3, maxDepth=2).stages, "y", balance=False).fit(frame)
    fitted = scorer.model.stages[-2]
    want = plain_boost(trees.binned(x, json.loads(fitted.getOrDefault("edges"))), y, 3, 2, 0.1, 1.0, 3)
    got = {r.id: r.score for r in scorer.score(frame).collect()}
    assert np.allclose([got[i] for i in range(len(y))], want)


def test_extra_trees_learn_what_one_cut_cannot(spark):
    x, y, frame = tree_rows(spark)
    scorer = models.build_model("extra_trees", features=["a", "b", "c", "d"], numTrees=20, maxDepth=6).fit(frame.where("id < 300"))
    assert metrics.auroc(scorer.score(frame.where("id >= 300")), "y", "score").first().auroc > 0.85
    grown = scorer.model.stages[-2]
    for feature, _, left, right, value in json.loads(grown.getOrDefault("trees")):
        assert all((f < 0) == (a == 0 and b == 0) for f, a, b in zip(feature, left, right, strict=True)) and all(0 <= v <= 1 for v in value)
    again = models.build_model("extra_trees", features=["a", "b", "c", "d"], numTrees=20, maxDepth=6).fit(frame.where("id < 300").repartition(2))
    for a, b in zip(json.loads(again.model.stages[-2].getOrDefault("trees")), json.loads(grown.getOrDefault("trees")), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4], b[4])


def test_trees_of_odd_tables(spark):
    one_class = spark.createDataFrame([(1.0, 1), (2.0, 1), (None, 1)], "a double, y long")
    assert {round(r.score, 3) for r in models.build_model("extra_trees", features=["a"], numTrees=2).fit(one_class).score(one_class).collect()} == {1.0}
    assert all(r.score > 0.99 for r in models.build_model("hist_gbm", features=["a"], numTrees=2).fit(one_class).score(one_class).collect())
    with pytest.raises(ValueError):
        models.build_model("hist_gbm", features=["a"]).fit(one_class.limit(0))


@pytest.mark.parametrize("name", ["elastic", "extra_trees", "hist_gbm", "svm"])
def test_saved_pipelines_score_alike(spark, tmp_path, name):
    _, _, frame = tree_rows(spark, 120)
    scorer = models.build_model(name, features=["a", "b"], **({"numTrees": 3} if name in ("extra_trees", "hist_gbm") else {})).fit(frame)
    want = {r.id: r.score for r in scorer.score(frame).collect()}
    scorer.save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert {r.id: r.score for r in loaded.transform(frame.drop("y")).collect()} == pytest.approx(want)


def test_unfitted_pipeline_and_coral_are_saved(spark, tmp_path):
    models.build_model("elastic", features=["a"]).pipeline().write().overwrite().save(str(tmp_path / "p"))
    _, _, frame = tree_rows(spark, 60)
    assert Pipeline.load(str(tmp_path / "p")).fit(frame).transform(frame).where("score is null").count() == 0
    rows = spark.createDataFrame([(float(i), i // 20) for i in range(60)], "a double, lv int")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), Coral(labelCol="lv", levels=3)]).fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "c"))
    again = PipelineModel.load(str(tmp_path / "c")).transform(rows)
    assert [r.level for r in again.orderBy("a").collect()] == [r.level for r in fitted.transform(rows).orderBy("a").collect()]
    assert again.where(F.col("level") == F.col("lv")).count() > 50


def test_vocabulary_equals_count_vectorizer(spark):
    rows = [("a b a c",), ("b a d d d",), ("",), (None,), ("a c",), ("a",)]
    frame = spark.createDataFrame(rows, "t string").select(F.split("t", " ").alias("terms"))
    full = frame.select(F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    for options in ({"minDF": 2.0}, {"minDF": 0.2, "maxDF": 0.5}, {"maxDF": 3.0}, {"vocabSize": 2}):
        got = Vocabulary(inputCol="terms", outputCol="n", **options).fit(frame).vocabulary
        want = CountVectorizer(inputCol="terms", outputCol="n", **options).fit(full).vocabulary
        assert set(got) == set(want), options
    assert Vocabulary(inputCol="terms", outputCol="n").fit(frame).vocabulary == ["a", "d", "b", "c", ""]  # 5, 3, 2, 2 and 1


def test_a_text_model_cuts_texts_twice(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        reads.add(1)
        return text

    rows = spark.createDataFrame([(i, f"word{i % 7} other{i % 3} same", i % 2) for i in range(60)], "id long, t string, y long")
    fitted = models.build_model("tfidf", min_df=2, size=50).fit(rows.select("id", read.asNondeterministic()("t").alias("text"), "y"))
    # Once for the vocabulary and once for the counts; the weights of classes may read the rows as well.
    assert reads.value <= 3 * 60
    got = fitted.score(rows.withColumnRenamed("t", "text"))
    assert got.columns == ["id", "text", "y", "weight", "features", "rawPrediction", "probability", "prediction", "score", "pred"] and got.where("score between 0 and 1").count() == 60
    assert not [c for c in got.columns if c.startswith("_")]
