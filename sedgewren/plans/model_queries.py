"""Queries of further models, of what they have learned, and of whole evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, metrics, models, reports, splits
from ..sources import files
from ..streaming import events as E
from ..session import stored
from .adapters import LABELLED, labelled, posts, rounded
from .catalog import register
from .eval_queries import BEST, drawn_sql, featured


def kept_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The features as a written table, since every fit reads them many times."""
    rows, names = featured(spark, sf_dir)
    path = f"{E.working_folder(spark)}/features"
    files.write_parquet(rows, path)
    return spark.read.parquet(path), names


def scores_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows, names = kept_features(spark, sf_dir)
    return rounded(models.build_model(name, features=names).fit(rows).score(rows).select("doc_id", "score", "pred"))


@register("forest_scores")
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(spark, sf_dir, "forest")


@register("elastic_scores")
def elastic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(spark, sf_dir, "elastic")


@register("svm_scores")
def svm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(spark, sf_dir, "svm")


@register("extra_trees_scores")
def extra_trees_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(spark, sf_dir, "extra_trees")


@register("hist_gbm_scores")
def hist_gbm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(spark, sf_dir, "hist_gbm")


@register("gbt_early_scores")
def gbt_early_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(spark, sf_dir, "gbt_early")


@register("stacked_scores")
def stacked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic regression over out-of-fold scores of two models."""
    rows, names = kept_features(spark, sf_dir)
    makers = {"elastic": lambda: models.build_model("elastic", features=names, rounds=20), "forest": lambda: models.build_model("forest", features=names, numTrees=10)}
    return rounded(models.stacked(rows, makers, "doc_id")[1].select("doc_id", "s_elastic", "s_forest", "score", "pred"))


@register("community_classifier")
def community_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text, in the place of its community, by a multinomial model of its words that was fitted on three of four folds."""
    rows = models.community_classes(posts(spark, sf_dir).select("doc_id", "text", "lang"), "lang")
    marked = stored(splits.folds(rows, "doc_id", 4))
    fitted = models.build_model("multinomial", min_df=3, size=5_000, rounds=15).fit(marked.where("fold <> 0"))
    return fitted.score(marked).select("doc_id", "lang", "fold", F.col("y").cast("long").alias("y"), F.col("prediction").cast("long").alias("found"))


@register("nested_grid")
def nested_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by forests whose depth is chosen within each outer fold."""
    rows, names = kept_features(spark, sf_dir)
    made = lambda **o: models.build_model("forest", features=names, numTrees=10, **o)
    return rounded(models.nested_grid(rows, made, [{"maxDepth": 2}, {"maxDepth": 5}], "doc_id", outer=3, inner=2).select("doc_id", "fold", "chosen", "score", "pred"))


@register("feature_ablation")
def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out AUROC without each group of features, and with that group only."""
    rows, names = kept_features(spark, sf_dir)
    groups = {"terms": [n for n in names if n.startswith(("f_anx", "f_health", "f_dep", "f_suic", "f_reass", "f_body"))], "pronouns": [n for n in names if n.startswith(("f_first", "f_second", "f_third"))], "length": [n for n in names if n.startswith(("f_n_", "f_avg"))]}
    marked, out = splits.folds(rows, "doc_id", 4), None
    for mask, columns in splits.feature_masks(names, groups).items():
        fitted = models.build_model("elastic", features=columns, rounds=20).fit(marked.where("fold <> 0"))
        part = metrics.auroc(fitted.score(marked.where("fold = 0")), "y", "score").select(F.lit(mask).alias("mask"), F.lit(len(columns)).cast("long").alias("n_features"), "auroc")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@register("top_terms")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten terms of greatest and of least weight (a report's limit)."""
    rows = labelled(spark, sf_dir).select("doc_id", "text", "y")
    found = models.top_terms(models.build_model("tfidf", min_df=3, size=20_000).fit(rows), 10)
    return rounded(spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(found, 1)], "place long, term string, weight double"))


@register("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of accuracy of each feature when it is moved to other rows."""
    rows, names = kept_features(spark, sf_dir)
    fitted = models.build_model("elastic", features=names).fit(rows)
    return rounded(models.permutation_importances(rows, fitted, "doc_id", names))


def full_report_sql(draws: int = 500) -> str:
    """Sweeps over the scores of the whole table and of each draw; the threshold is that of greatest F1 on the whole."""
    sweep = lambda rows, by: f"(SELECT *, sum(pos) OVER ({by} ORDER BY score DESC) AS tp, sum(neg) OVER ({by} ORDER BY score DESC) AS fp, sum(neg) OVER ({by} ORDER BY score) AS below, sum(pos) OVER ({by}) AS all_pos, sum(neg) OVER ({by}) AS all_neg FROM {rows})"
    areas = "sum(pos * (below - neg / 2)) / nullif(any_value(all_pos) * any_value(all_neg), 0) AS auroc, sum(coalesce(pos / nullif(all_pos, 0), 0) * coalesce(tp / nullif(tp + fp, 0), 0)) AS auprc"
    f1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
    counts = "coalesce(sum(n) FILTER (y = 1 AND score >= t), 0) AS tp, coalesce(sum(n) FILTER (y = 0 AND score >= t), 0) AS fp, coalesce(sum(n) FILTER (y = 1 AND score < t), 0) AS fn, coalesce(sum(n) FILTER (y = 0 AND score < t), 0) AS tn"
    limits = ", ".join(f"round(quantile_cont({m}, {q}), 6) AS {m}_ci_{side}" for m in ("f1", "auroc", "auprc") for side, q in (("lo", 0.025), ("hi", 0.975)))
    return f"""
WITH {LABELLED}, {drawn_sql(draws)},
whole AS MATERIALIZED (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM labelled GROUP BY score),
parts AS MATERIALIZED (SELECT draw, score, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM drawn WHERE w > 0 GROUP BY draw, score),
best AS (SELECT score AS t FROM {sweep("whole", "")} ORDER BY round({BEST}, 12) DESC, score LIMIT 1),
m AS (SELECT *, (SELECT avg(pow(score - y, 2)) FROM labelled) AS brier FROM (SELECT {counts} FROM (SELECT score, y, 1 AS n FROM labelled), best)),
a AS (SELECT {areas} FROM {sweep("whole", "")}),
d AS (SELECT draw, {areas} FROM {sweep("parts", "PARTITION BY draw")} GROUP BY draw),
f AS (SELECT draw, {f1} AS f1 FROM (SELECT draw, {counts} FROM (SELECT draw, score, y, w AS n FROM drawn WHERE w > 0), best GROUP BY draw)),
l AS (SELECT {limits} FROM d JOIN f USING (draw)),
e AS (SELECT sum(n * abs(observed - predicted)) / sum(n) AS ece FROM (SELECT count(*) AS n, avg(CAST(y AS DOUBLE)) AS observed, avg(score) AS predicted FROM labelled GROUP BY least(floor(score * 10), 9)))
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round({f1}, 6) AS f1, round(brier, 6) AS brier, CAST(tp + fn AS BIGINT) AS support_pos, CAST(fp + tn AS BIGINT) AS support_neg,
       round(t, 6) AS threshold, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(ece, 6) AS ece, l.* FROM m, best, a, e, l"""


@register("full_report", full_report_sql())
def full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.full_report(labelled(spark, sf_dir), "doc_id"))


AGREED = "SELECT '{0}' AS model, '{1}' AS target, '{2}' AS metric, round({3}, 6) AS value FROM labelled"


@register("aggregate_reports", f"WITH {LABELLED} " + " UNION ALL ".join(AGREED.format(m, "toxic", k, v) for m, s in (("a", "score"), ("b", "score_b")) for k, v in (("mean", f"avg({s})"), ("rate", f"avg(CAST({s} >= 0.5 AS DOUBLE))"))))
def aggregate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two models, written as JSON files and gathered again; model and target come from the file names."""
    folder, rows = E.working_folder(spark), labelled(spark, sf_dir)
    for name, score in (("a", "score"), ("b", "score_b")):
        files.dump_json(rows.agg(F.avg(score).alias("mean"), F.avg((F.col(score) >= 0.5).cast("double")).alias("rate")), f"{folder}/{name}__toxic__metrics.json")
    return rounded(reports.read_reports(spark, f"{folder}/*__metrics.json"))


@register("audit_warnings", f"WITH {LABELLED}, s AS (SELECT count(*) AS n, count(DISTINCT source) FILTER (toxic = 1) AS u FROM labelled) SELECT 'only ' || n || ' posts' AS warning FROM s UNION ALL SELECT 'only ' || u || ' disclosed users for toxic' FROM s WHERE u < 50")
def audit_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = labelled(spark, sf_dir).agg(F.count("*").alias("n_posts"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("source"))).alias("users_toxic")).first().asDict()
    return spark.createDataFrame([(w,) for w in audit.warnings(figures, least_posts=1_000_000_000)], "warning string")
