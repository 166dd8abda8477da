"""Report operators on small rows."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sedgewren.operators import metrics, models, reports, stats


def test_counted_stage(spark):
    frame, rows = reports.counted(spark.range(7), "stage")
    assert rows == 7 and sorted(r.id for r in frame.collect()) == list(range(7))


def test_frozen_point_without_positives(spark):
    got = {r.p: r for r in reports.frozen_point(spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.2), ("b", 0, 0.9)], "p string, y int, score double"), 0.5, "p").collect()}
    assert got["a"].f1 == 1.0 and got["b"].f1 is None and got["b"].positive_rate == 1.0


def test_pseudonyms_leave_no_name(spark):
    raw = spark.createDataFrame([("ann", 1), ("bob", 2)], "author string, n int")
    cohort = reports.by_pseudonym(raw, "author", raw.where("n = 1").select(F.concat(F.lit("u_"), F.substring(F.sha2(F.concat(F.lit("anxiety-research-v1|"), "author"), 256), 1, 12)).alias("author_hash")))
    assert "author" not in cohort.columns and [r.n for r in cohort.collect()] == [1]


def test_metric_files(spark, tmp_path):
    (tmp_path / "tfidf__anxiety__metrics.json").write_text(json.dumps({"f1": 0.5, "note": "x"}))
    (tmp_path / "gbt__anxiety__metrics.json").write_text(json.dumps({"f1": 0.25}))
    rows = {(r.model, r.metric): r.value for r in reports.read_reports(spark, f"{tmp_path}/*__metrics.json").collect()}
    assert rows == {("tfidf", "f1"): 0.5, ("tfidf", "note"): None, ("gbt", "f1"): 0.25}


def test_samples_and_reindexing(spark):
    frame = spark.range(100).selectExpr("id", "id % 4 = 0 as y")
    got = reports.stratified_sample(frame, "y", "id", 20).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {True: 5, False: 15}
    keys = spark.createDataFrame([("a",), ("z",)], "k string")
    assert {r.k: r.n for r in reports.reindex(spark.createDataFrame([("a", 3)], "k string, n int"), keys, "k", {"n": 0}).collect()} == {"a": 3, "z": 0}


def test_full_report_of_known_scores(spark):
    rows = spark.range(200).selectExpr("id", "cast(id % 4 = 0 as long) as y", "if(id % 4 = 0, 0.9D, 0.2D) as score")
    got = reports.full_report(rows, "id", draws=20).first()
    assert (got.f1, got.auroc, got.auprc, got.threshold) == (1.0, 1.0, 1.0, 0.9)
    assert got.f1_ci_lo == got.auroc_ci_hi == got.auprc_ci_lo == 1.0


def test_resamples_keep_their_size_on_average(spark):
    n = {r.draw: r["count"] for r in stats.resampled(spark.range(1000), "id", 10).groupBy("draw").count().collect()}
    assert len(n) == 10 and all(850 < v < 1150 for v in n.values())


@pytest.mark.parametrize("name, grid", [("elastic", [{"mix": 0.0}, {"mix": 0.5}]), ("forest", [{"numTrees": 3, "maxDepth": 1}, {"numTrees": 5, "maxDepth": 3}])])
def test_nested_grid_scores_each_row_once(spark, name, grid):
    seen = Observation("rows")  # an observation in the session must not break the fits
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    rows = spark.range(60).selectExpr("id", "cast(id % 2 as long) as y", "cast(id % 2 as double) * 3 + cast(id % 7 as double) as a")
    made = lambda **o: models.build_model(name, features=["a"], **o)
    got = models.nested_grid(rows, made, grid, "id", outer=2, inner=2).collect()
    assert sorted(r.id for r in got) == list(range(60)) and {r.chosen for r in got} <= {0, 1}
    assert len({(r.fold, r.chosen) for r in got}) == 2 and all(0 <= r.score <= 1 for r in got)


def test_nested_grid_chooses_within_folds_alone(spark):
    """The options that rank the rows win in each fold; the others give all rows one score."""
    rows = spark.range(80).selectExpr("id", "cast(id % 2 as long) as y", "cast(id % 2 as double) as a", "0D as b")
    made = lambda use: models.build_model("elastic", features=[use])
    got = models.nested_grid(rows, made, [{"use": "b"}, {"use": "a"}], "id", outer=2, inner=2)
    assert {r.chosen for r in got.select("chosen").distinct().collect()} == {1}
    assert metrics.auroc(got, "y", "score").first().auroc == 1.0
