"""Queries of evaluation: metrics, statistics, users, early detection, models, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import perturb
from ..functions import text as T
from ..operators import early, metrics, models, splits, stats, users
from ..operators import labels as L
from ..streaming import events as E
from ..session import stored
from .adapters import LABELLED, PROBE, STREAM, TOKENS, hits, labelled, rounded, stream
from .catalog import register, table
from .text_queries import perturbed_sql

# Confusion counts of labelled posts at 0.5, and the sweep over distinct scores.
CONF = "CAST(sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn"
F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
SWEEP = "g AS (SELECT {by}score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM {src} GROUP BY {by}score), c AS (SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp, sum(pos) OVER ({part}) AS all_pos, sum(neg) OVER ({part} ORDER BY score) AS below FROM g)"


def sweep(src: str = "labelled", by: str = "") -> str:
    return SWEEP.format(src=src, by=f"{by}, " if by else "", part=f"PARTITION BY {by}" if by else "")


@register("basic_metrics", f"WITH {LABELLED}, k AS (SELECT {CONF}, avg(pow(score - y, 2)) AS brier FROM labelled) SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round({F1}, 6) AS f1, round(brier, 6) AS brier, CAST(tp + fn AS BIGINT) AS support_pos, CAST(fp + tn AS BIGINT) AS support_neg FROM k")
def basic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.basic_metrics(labelled(spark, sf_dir)))


@register("auroc", f"WITH {LABELLED}, {sweep()} SELECT round(sum(pos * (below - neg / 2)) / (sum(pos) * sum(neg)), 6) AS auroc FROM c")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auroc(labelled(spark, sf_dir)))


@register("auprc", f"WITH {LABELLED}, {sweep()} SELECT round(sum(pos / all_pos * tp / (tp + fp)), 6) AS auprc FROM c")
def auprc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auprc(labelled(spark, sf_dir)))


BEST = "2 * (tp / (tp + fp)) * (tp / all_pos) / (tp / (tp + fp) + tp / all_pos + 1e-12)"


@register("best_threshold_f1", f"WITH {LABELLED}, {sweep()} SELECT round(score, 6) AS threshold, round({BEST}, 6) AS f1 FROM c ORDER BY round({BEST}, 12) DESC, score LIMIT 1")
def best_threshold_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_threshold(labelled(spark, sf_dir)))


BINS = "b AS (SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(CAST(y AS DOUBLE)) AS observed, avg(score) AS predicted FROM labelled GROUP BY 1)"


@register("calibration_bins", f"WITH {LABELLED}, {BINS} SELECT bin, n, round(observed, 6) AS observed, round(predicted, 6) AS predicted FROM b")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration(labelled(spark, sf_dir)))


@register("ece", f"WITH {LABELLED}, {BINS} SELECT round(sum(n * abs(observed - predicted)) / sum(n), 6) AS ece FROM b")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_error(labelled(spark, sf_dir)))


@register("bucket_counts", f"WITH {LABELLED} SELECT CASE WHEN pred = 1 THEN CASE WHEN y = 1 THEN 'TP' ELSE 'FP' END ELSE CASE WHEN y = 1 THEN 'FN' ELSE 'TN' END END AS bucket, count(*) AS n, CAST(sum(CAST(pred <> y AS INT)) AS BIGINT) AS errors FROM labelled GROUP BY 1")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.add_predictions(labelled(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("err").alias("errors"))


@register("confusion_by_group", f"WITH {LABELLED}, k AS (SELECT source, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, {CONF} FROM labelled GROUP BY source) SELECT source, n, n_pos, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round({F1}, 6) AS f1 FROM k")
def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion_by(labelled(spark, sf_dir), "source"))


@register("length_effect", f"""WITH {LABELLED}, e AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS q FROM labelled),
b AS (SELECT l.*, CASE WHEN n_chars <= q[1] THEN 0 WHEN n_chars <= q[2] THEN 1 WHEN n_chars <= q[3] THEN 2 WHEN n_chars <= q[4] THEN 3 ELSE 4 END AS bin FROM labelled l, e), k AS (SELECT bin, count(*) AS n, avg(n_chars) AS m, {CONF} FROM b GROUP BY bin)
SELECT CAST(bin AS BIGINT) AS bin, n, round(m, 6) AS mean_length, round({F1}, 6) AS f1 FROM k""")
def length_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.length_effect(labelled(spark, sf_dir), "n_chars"))


SUBGROUPS = f"k AS (SELECT lang, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, {CONF} FROM labelled WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 20 AND sum(y) >= 2), s AS (SELECT lang, n, n_pos, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr, {F1} AS f1, (tp + fp) / n AS selection_rate FROM k)"


@register("fairness_subgroups", f"WITH {LABELLED}, {SUBGROUPS} SELECT lang, n, n_pos, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(f1, 6) AS f1, round(selection_rate, 6) AS selection_rate FROM s")
def fairness_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.subgroup_metrics(labelled(spark, sf_dir), "lang", min_n=20, min_pos=2))


@register("fairness_gaps", f"WITH {LABELLED}, {SUBGROUPS} SELECT CASE WHEN count(*) >= 2 THEN round(max(tpr) - min(tpr), 6) END AS tpr_gap, CASE WHEN count(*) >= 2 THEN round(max(fpr) - min(fpr), 6) END AS fpr_gap, CASE WHEN count(*) >= 2 THEN round(max(selection_rate) - min(selection_rate), 6) END AS selection_rate_gap, CASE WHEN count(*) >= 2 THEN round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) END AS equalized_odds_diff FROM s")
def fairness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.fairness_gaps(metrics.subgroup_metrics(labelled(spark, sf_dir), "lang", min_n=20, min_pos=2)))


#: Events as scored rows of groups, for thresholds by group.
SCORED = STREAM + ", scored AS (SELECT event_id, event_type, round(score, 2) AS score, CAST(event_id % 4 = 0 AS BIGINT) AS y FROM stream)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).select("event_id", "event_type", F.round("score", 2).alias("score"), (F.col("event_id") % 4 == 0).cast("long").alias("y"))


GROUP_THR = f"""{sweep('scored', 'event_type')}, own AS (SELECT event_type, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round({BEST}, 12) DESC, score) AS r FROM c) WHERE r = 1)"""


@register("group_thresholds", f"WITH {SCORED}, {GROUP_THR} SELECT event_type, round(threshold, 6) AS threshold, CAST(1 AS BIGINT) AS tuned FROM own")
def group_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.group_thresholds(scored(spark, sf_dir), "event_type"))


@register("group_threshold_apply", f"WITH {SCORED}, {GROUP_THR}, p AS (SELECT s.event_type, s.y, CAST(s.score >= coalesce(o.threshold, 0.5) AS BIGINT) AS pred FROM scored s LEFT JOIN own o ON s.event_type = o.event_type), k AS (SELECT event_type, {CONF} FROM p GROUP BY event_type HAVING sum(y) >= 5) SELECT round(avg({F1}), 6) AS macro_f1, count(*) AS n_groups FROM k")
def group_threshold_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    pred = metrics.apply_thresholds(rows, metrics.group_thresholds(rows, "event_type"), "event_type")
    return rounded(metrics.macro_f1(pred, "event_type"))


@register("model_agreement", f"WITH {LABELLED} SELECT round(avg(CAST(pred <> pred_b AS DOUBLE)), 6) AS flip_rate, round(avg(abs(score - score_b)), 6) AS mean_abs_drift FROM labelled")
def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.flip_rate(labelled(spark, sf_dir), "pred", "pred_b", "score", "score_b"))


@register("class_f1", f"WITH {LABELLED}, p AS (SELECT lang AS y, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS p FROM labelled), k AS (SELECT DISTINCT y AS c FROM p), f AS (SELECT c, sum(CASE WHEN y = c AND p = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = c THEN 1 ELSE 0 END) AS s, sum(CASE WHEN p = c THEN 1 ELSE 0 END) AS d FROM k, p GROUP BY c) SELECT round(sum(s * 2 * tp / (s + d)) / sum(s), 6) AS weighted_f1, round(avg(2 * tp / (s + d)), 6) AS macro_f1 FROM f")
def class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir).select(F.col("lang").alias("y"), F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")).alias("p"))
    return rounded(metrics.class_f1(p, "y", "p"))


@register("confusion_matrix", f"WITH {LABELLED}, p AS (SELECT lang AS y, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS pred FROM labelled) SELECT y, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS row_share FROM p GROUP BY y, pred")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir).select("lang", F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")).alias("p"))
    return rounded(metrics.confusion_matrix(p, "lang", "p"))


@register("cohen_kappa", f"WITH {LABELLED}, k AS (SELECT count(*) AS n, avg(CAST(pred = pred_b AS DOUBLE)) AS po, avg(pred) AS pa, avg(pred_b) AS pb FROM labelled) SELECT n, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) AS kappa FROM k")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cohen_kappa(labelled(spark, sf_dir), "pred", "pred_b"))


@register("weighted_kappa", f"WITH {LABELLED}, v AS (SELECT CAST(floor(score * 4) AS BIGINT) AS i, CAST(floor(score_b * 4) AS BIGINT) AS j FROM labelled), r AS (SELECT i, count(*) AS ni FROM v GROUP BY i), c AS (SELECT j, count(*) AS nj FROM v GROUP BY j), e AS (SELECT sum(pow(i - j, 2) * ni * nj) AS e FROM r, c) SELECT round(1 - sum(pow(i - j, 2)) * count(*) / max(e), 6) AS qwk, round(avg(abs(i - j)), 6) AS mae, round(avg(CAST(abs(i - j) > 1 AS DOUBLE)), 6) AS far_share FROM v, e")
def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = labelled(spark, sf_dir).select(F.floor(F.col("score") * 4).alias("i"), F.floor(F.col("score_b") * 4).alias("j"))
    return rounded(metrics.weighted_kappa(v, "i", "j", 4))


@register("mcnemar_counts", f"WITH {LABELLED} SELECT CAST(sum(CAST(pred = y AND pred_b <> y AS INT)) AS BIGINT) AS b, CAST(sum(CAST(pred <> y AND pred_b = y AS INT)) AS BIGINT) AS c FROM labelled")
def mcnemar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mcnemar(labelled(spark, sf_dir), "y", "pred", "pred_b").select("b", "c")


#: Three models' predictions in long form, compared pair by pair on the row's id.
PREDICTIONS = LABELLED + ", long AS (SELECT doc_id, 'a' AS model, y, pred FROM labelled UNION ALL SELECT doc_id, 'b', y, pred_b FROM labelled UNION ALL SELECT doc_id, 'c', y, CAST(doc_id % 2 AS BIGINT) FROM labelled)"


@register("pairwise_model_join", f"WITH {PREDICTIONS} SELECT p.model AS model_a, q.model AS model_b, count(*) AS n, CAST(sum(CAST(p.pred = p.y AND q.pred <> p.y AS INT)) AS BIGINT) AS b, CAST(sum(CAST(p.pred <> p.y AND q.pred = p.y AS INT)) AS BIGINT) AS c FROM long p JOIN long q ON p.doc_id = q.doc_id AND p.model < q.model GROUP BY 1, 2")
def pairwise_model_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    long = rows.selectExpr("doc_id", "y", "stack(3, 'a', pred, 'b', pred_b, 'c', doc_id % 2) as (model, pred)")
    a, b = long.alias("p"), long.alias("q")
    both = a.join(b, (F.col("p.doc_id") == F.col("q.doc_id")) & (F.col("p.model") < F.col("q.model")))
    return both.groupBy(F.col("p.model").alias("model_a"), F.col("q.model").alias("model_b")).agg(
        F.count("*").alias("n"), F.sum(((F.col("p.pred") == F.col("p.y")) & (F.col("q.pred") != F.col("p.y"))).cast("long")).alias("b"), F.sum(((F.col("p.pred") != F.col("p.y")) & (F.col("q.pred") == F.col("p.y"))).cast("long")).alias("c"),
    )


def _parts(s: str) -> str:
    return f"(SELECT count(*) + 0.0 FROM labelled n WHERE n.y = 0 AND n.{s} < l.{s}) + (SELECT count(*) FROM labelled n WHERE n.y = 0 AND n.{s} = l.{s}) / 2"


def _parts0(s: str) -> str:
    return f"(SELECT count(*) + 0.0 FROM labelled n WHERE n.y = 1 AND n.{s} > l.{s}) + (SELECT count(*) FROM labelled n WHERE n.y = 1 AND n.{s} = l.{s}) / 2"


@register("delong_components", f"""WITH {LABELLED}, m AS (SELECT sum(y) AS p, sum(1 - y) AS q FROM labelled), v AS (SELECT y, CASE WHEN y = 1 THEN ({_parts('score')}) / q ELSE ({_parts0('score')}) / p END AS a, CASE WHEN y = 1 THEN ({_parts('score_b')}) / q ELSE ({_parts0('score_b')}) / p END AS b FROM labelled l, m),
w AS (SELECT y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cab FROM v GROUP BY y)
SELECT round(max(CASE WHEN y = 1 THEN ma END), 6) AS auc_a, round(max(CASE WHEN y = 1 THEN mb END), 6) AS auc_b, round(sum(va / n), 6) AS var_a, round(sum(vb / n), 6) AS var_b, round(sum(cab / n), 6) AS cov FROM w""")
def delong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.delong_parts(labelled(spark, sf_dir), "y", ("score", "score_b")))


MARKERS = {"f_len": "CAST(n_chars AS DOUBLE)", "f_score": "score", "f_id": "CAST(doc_id % 13 AS DOUBLE)"}
LONG = LABELLED + ", lf AS (" + " UNION ALL ".join(f"SELECT y, '{k}' AS feature, {v} AS v FROM labelled" for k, v in MARKERS.items()) + ")"


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).withColumns({"f_len": F.col("n_chars").cast("double"), "f_score": F.col("score"), "f_id": (F.col("doc_id") % 13).cast("double")})


D_SQL = "d AS (SELECT feature, count(v) FILTER (y = 1) AS n_pos, count(v) FILTER (y = 0) AS n_neg, avg(v) FILTER (y = 1) AS mean_pos, avg(v) FILTER (y = 0) AS mean_neg, var_samp(v) FILTER (y = 1) AS v1, var_samp(v) FILTER (y = 0) AS v0 FROM lf GROUP BY feature)"
D_EXPR = "(mean_pos - mean_neg) / sqrt(((n_pos - 1) * v1 + (n_neg - 1) * v0) / (n_pos + n_neg - 2))"


@register("cohens_d_markers", f"WITH {LONG}, {D_SQL} SELECT feature, n_pos, n_neg, round(mean_pos, 6) AS mean_pos, round(mean_neg, 6) AS mean_neg, round({D_EXPR}, 6) AS cohen_d FROM d")
def cohens_d_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.cohens_d(markers(spark, sf_dir), "y", list(MARKERS)))


U_SQL = "mg AS (SELECT feature, v, sum(CAST(y = 1 AS INT)) AS pos, sum(CAST(y = 0 AS INT)) AS neg FROM lf GROUP BY feature, v), mr AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY v) AS below FROM mg), mu AS (SELECT feature, sum(pos * (below - neg / 2)) AS u, CAST(sum(pos) AS BIGINT) AS n1, CAST(sum(neg) AS BIGINT) AS n2 FROM mr GROUP BY feature)"


@register("mannwhitney_u", f"WITH {LONG}, {U_SQL} SELECT feature, round(u, 6) AS u, n1, n2 FROM mu")
def mannwhitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mann_whitney(markers(spark, sf_dir), "y", list(MARKERS)).drop("p"))


@register("bh_adjust", "WITH p AS (SELECT n_name AS feature, ((n_nationkey * 37 + 11) % 100) / 1000 AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS r, count(*) OVER () AS m FROM p) SELECT feature, round(least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_bh FROM r")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "nation").select(F.col("n_name").alias("feature"), (((F.col("n_nationkey") * 37 + 11) % 100) / 1000.0).alias("p"))
    return rounded(stats.bh_adjust(p).select("feature", "p_bh"))


#: The two-sided tail of the normal law by the operator's rational approximation of erfc, from the constant up.
TAIL = "-1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))"
P_SQL = f"""{U_SQL}, ties AS (SELECT feature, sum(pow(CAST(pos + neg AS DOUBLE), 3) - (pos + neg)) AS ties FROM mg GROUP BY feature),
z AS (SELECT mu.*, (abs(u - CAST(n1 AS DOUBLE) * n2 / 2) - 0.5) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) / sqrt(2::DOUBLE) AS z FROM mu JOIN ties ON mu.feature = ties.feature),
x AS (SELECT feature, u, greatest(z, 0) AS x, CAST(1 AS DOUBLE) / (1 + 0.5::DOUBLE * greatest(z, 0)) AS t FROM z), ps AS (SELECT feature, u, least(1, t * exp(-x * x + {TAIL})) AS p FROM x),
pr AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS r, count(*) OVER () AS m FROM ps), pb AS (SELECT *, least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh FROM pr)"""


@register("compare_features", f"WITH {LONG}, {D_SQL}, {P_SQL} SELECT d.feature, n_pos, n_neg, round(mean_pos, 6) AS mean_pos, round(mean_neg, 6) AS mean_neg, round({D_EXPR}, 6) AS cohen_d, round(u, 6) AS u, round(p, 6) AS p, round(p_bh, 6) AS p_bh, CAST(p_bh < 0.05 AS BIGINT) AS significant FROM d JOIN pb ON d.feature = pb.feature")
def compare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.compare_features(markers(spark, sf_dir), "y", list(MARKERS)).orderBy(F.desc(F.abs("cohen_d"))))


@register("marker_heatmap", f"WITH {LONG}, {D_SQL}, e AS (SELECT feature, {D_EXPR} AS d FROM d), s AS (SELECT *, row_number() OVER (ORDER BY abs(d) DESC, feature) AS r FROM e) SELECT feature, round(CASE WHEN r <= 2 THEN d ELSE 0 END, 6) AS d FROM s")
def marker_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.cohens_d(markers(spark, sf_dir), "y", list(MARKERS))  # a row for each feature
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("cohen_d")), "feature"))
    return rounded(d.withColumn("r", rank).select("feature", F.when(F.col("r") <= 2, F.col("cohen_d")).otherwise(0.0).alias("d")))


@register("contribution_summary", f"WITH {LABELLED}, c AS (SELECT 'a' AS feature, score AS v, score * 2 - 1 AS c FROM labelled UNION ALL SELECT 'b', score, -score_b * score FROM labelled UNION ALL SELECT 'z', 1, score FROM labelled) SELECT feature, round(avg(abs(c)), 6) AS mean_abs, CASE WHEN stddev_pop(v) < 1e-12 OR stddev_pop(c) < 1e-12 THEN '0' WHEN corr(v, c) >= 0 THEN '+' ELSE '-' END AS sign FROM c GROUP BY feature")
def contribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select(F.col("score").alias("a"), (F.col("score") * 2 - 1).alias("ca"), F.col("score").alias("b"), (-F.col("score_b") * F.col("score")).alias("cb"), F.lit(1.0).alias("z"), F.col("score").alias("cz"))
    return rounded(stats.contribution_summary(rows, [("a", "ca"), ("b", "cb"), ("z", "cz")]))


@register("confident_issues", f"WITH {LABELLED} SELECT CAST(CASE WHEN y = 1 AND score <= 0.1::DOUBLE THEN 1 WHEN y = 0 AND score >= 0.9::DOUBLE THEN 2 ELSE 0 END AS BIGINT) AS issue, count(*) AS n FROM labelled GROUP BY 1")
def confident_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.label_issues(labelled(spark, sf_dir), "y", "score").groupBy("issue").agg(F.count("*").alias("n"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rows.select("doc_id", "y", T.vote(F.col("score"), 0.6, 0.4).alias("v1"), T.vote(F.col("score_b"), 0.7, 0.3).alias("v2"), (F.col("quality") * 2 - 1).cast("long").alias("v3"))


@register("vote_majority", f"WITH {LABELLED}, v AS (SELECT doc_id, list_filter([CASE WHEN score <= 0.4::DOUBLE THEN 0 WHEN score >= 0.6::DOUBLE THEN 1 ELSE -1 END, CASE WHEN score_b <= 0.3::DOUBLE THEN 0 WHEN score_b >= 0.7::DOUBLE THEN 1 ELSE -1 END, quality * 2 - 1], lambda x: x >= 0) AS l FROM labelled) SELECT doc_id, round(CASE WHEN len(l) = 0 THEN 0.5 ELSE list_sum(l) / len(l) END, 6) AS p FROM v")
def vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(votes(spark, sf_dir).select("doc_id", L.majority(["v1", "v2", "v3"]).alias("p")))


def dawid_skene_sql(rounds: int = 100) -> str:
    """Expectation and maximisation over vote patterns, a row of parameters for each round."""
    cut = lambda x: f"least(greatest({x}, 1e-3), 1 - 1e-3)"
    vote = lambda k, right, wrong: f"CASE v{k} WHEN 1 THEN ln({right}) WHEN 0 THEN ln({wrong}) ELSE 0 END"
    edge = lambda x: f"ln(CASE WHEN {x} IN (0, 1) THEN {cut(x)} ELSE {x} END)"
    one = " + ".join([edge("pi"), *[vote(k, cut(f"s{k}"), f"1 - {cut(f's{k}')}") for k in (1, 2, 3)]])
    zero = " + ".join([edge("(1 - pi)"), *[vote(k, f"1 - {cut(f'c{k}')}", cut(f"c{k}")) for k in (1, 2, 3)]])
    means = ", ".join(f"sum(p * n) FILTER (v{k} = 1) / greatest(1e-9, sum(p * n) FILTER (v{k} IN (0, 1))), sum((1 - p) * n) FILTER (v{k} = 0) / greatest(1e-9, sum((1 - p) * n) FILTER (v{k} IN (0, 1)))" for k in (1, 2, 3))
    v = "CASE WHEN {0} <= {1}::DOUBLE THEN 0 WHEN {0} >= {2}::DOUBLE THEN 1 ELSE -1 END"
    return f"""
WITH RECURSIVE {LABELLED}, v AS (SELECT doc_id, {v.format("score", 0.4, 0.6)} AS v1, {v.format("score_b", 0.3, 0.7)} AS v2, quality * 2 - 1 AS v3 FROM labelled),
g AS MATERIALIZED (SELECT v1, v2, v3, count(*) AS n FROM v GROUP BY ALL),
e(round, pi, s1, c1, s2, c2, s3, c3) AS (SELECT 0, CAST(0.5 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0.7 AS DOUBLE), CAST(0.7 AS DOUBLE)
  UNION ALL SELECT round + 1, sum(p * n) / sum(n), {means} FROM (SELECT *, 1 / (1 + exp(least(700, ({zero}) - ({one})))) AS p FROM e, g WHERE round < {rounds - 1}) GROUP BY round),
last AS (SELECT * FROM e ORDER BY round DESC LIMIT 1)
SELECT doc_id, round(1 / (1 + exp(least(700, ({zero}) - ({one})))), 6) AS posterior FROM v, last"""


@register("dawid_skene", dawid_skene_sql())
def dawid_skene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.dawid_skene(votes(spark, sf_dir), ["v1", "v2", "v3"])[0].select("doc_id", "posterior"))


def _user_scores(how: str) -> str:
    if how == "topk_mean":
        return f"WITH {STREAM}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC) AS n FROM stream) SELECT user_id, round(avg(score) FILTER (n <= 5), 6) AS score, CAST(max(label) AS BIGINT) AS label FROM r GROUP BY user_id"
    return f"WITH {STREAM} SELECT user_id, round({how}(score), 6) AS score, CAST(max(label) AS BIGINT) AS label FROM stream GROUP BY user_id"


@register("user_score_mean", _user_scores("avg"))
def user_score_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(users.aggregate_scores(stream(spark, sf_dir), "user_id", "score", "label", "mean"))


@register("user_score_max", _user_scores("max"))
def user_score_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(users.aggregate_scores(stream(spark, sf_dir), "user_id", "score", "label", "max"))


@register("user_score_topk", _user_scores("topk_mean"))
def user_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(users.aggregate_scores(stream(spark, sf_dir), "user_id", "score", "label", "topk_mean"))


@register("user_level_evaluation", f"WITH {STREAM}, u AS (SELECT user_id, round(avg(score), 9) AS score, max(label) AS y FROM stream GROUP BY user_id), {sweep('u')}, b AS (SELECT score AS threshold FROM c ORDER BY round({BEST}, 12) DESC, score LIMIT 1), p AS (SELECT y, CAST(score >= threshold AS BIGINT) AS pred FROM u, b), k AS (SELECT {CONF} FROM p) SELECT round(threshold, 6) AS threshold, round({F1}, 6) AS f1, CAST(tp + fn AS BIGINT) AS n_positive FROM k, b")
def user_level_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = users.aggregate_scores(stream(spark, sf_dir), "user_id", "score", "label", "mean").select("user_id", F.round("score", 9).alias("score"), F.col("label").alias("y"))
    best = metrics.best_threshold(per).first()["threshold"]
    m = metrics.basic_metrics(per, threshold=best)
    return rounded(m.select(F.lit(best).alias("threshold"), "f1", F.col("support_pos").alias("n_positive")))


NUMBERED = STREAM + ", k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS down FROM stream)"


@register("order_stats", f"""WITH {NUMBERED} SELECT user_id, round(avg(score), 6) AS s_mean, round(max(score), 6) AS s_max, round(min(score), 6) AS s_min, round(stddev_pop(score), 6) AS s_std, round(avg(score) FILTER (down <= 3), 6) AS s_top3, round(avg(score) FILTER (down <= 5), 6) AS s_top5,
 round(quantile_cont(score, 0.9), 6) AS s_p90, round(quantile_cont(score, 0.95), 6) AS s_p95, round(avg(CAST(score >= 0.5 AS DOUBLE)), 6) AS s_frac50, round(avg(CAST(score >= 0.7::DOUBLE AS DOUBLE)), 6) AS s_frac70, round(coalesce(min(CASE WHEN score >= 0.5 THEN k - 1 END), count(*)) / count(*), 6) AS s_first_cross,
 round(arg_max(score, k), 6) AS s_last, round(coalesce(regr_slope(score, k - 1), 0), 6) AS s_slope, round(sum(exp(-(n - k) / 5) * score) / sum(exp(-(n - k) / 5)), 6) AS s_recency, count(*) AS n_posts FROM k GROUP BY user_id""")
def order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(users.score_summary(stream(spark, sf_dir), "user_id", "score", "t", "event_id"))


@register("temporal_behaviour", f"""WITH {STREAM}, g AS (SELECT *, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) / 86400 AS gap, floor(t / 3600) % 24 AS h FROM stream),
a AS (SELECT user_id, count(*) AS n_posts, (max(t) - min(t)) / 86400 AS span_days, coalesce(avg(gap), 0) AS mu, coalesce(stddev_pop(gap), 0) AS sd, avg(CAST(h < 6 AS DOUBLE)) AS night, avg(CAST(h >= 19 AS DOUBLE)) AS evening, count(DISTINCT lower(event_type)) AS n_subs FROM g GROUP BY user_id)
SELECT user_id, n_posts, round(span_days, 6) AS span_days, round(mu, 6) AS ipi_mean, round(sd, 6) AS ipi_std, round(night, 6) AS night_frac, round(evening, 6) AS evening_frac, n_subs, round(n_posts / (span_days + 1), 6) AS posts_per_day, round(CASE WHEN sd + mu > 0 THEN (sd - mu) / (sd + mu) ELSE 0 END, 6) AS burstiness FROM a""")
def temporal_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(users.behaviour(stream(spark, sf_dir), "user_id", "t", "event_id", "event_type"))


def _entropy(value: str, plus: str = "") -> str:
    return f"(SELECT user_id, -sum(p * ln(p{plus})) AS e FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM stream GROUP BY user_id, {value}) GROUP BY user_id)"


@register("entropy_features", f"WITH {STREAM} SELECT a.user_id, round(a.e, 6) AS hour_entropy, round(b.e, 6) AS dow_entropy, round(c.e, 6) AS sub_entropy FROM {_entropy('floor(t / 3600) % 24')} a JOIN {_entropy('floor(t / 86400) % 7')} b ON a.user_id = b.user_id JOIN {_entropy('lower(event_type)', ' + 1e-12')} c ON a.user_id = c.user_id")
def entropy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(users.entropies(stream(spark, sf_dir), "user_id", "t", "event_type"))


@register("group_participation", f"WITH {STREAM} SELECT user_id, round(avg(CAST(lower(event_type) IN ('click', 'view') AS DOUBLE)), 6) AS subgrp_look, round(avg(CAST(lower(event_type) IN ('purchase') AS DOUBLE)), 6) AS subgrp_buy FROM stream GROUP BY user_id")
def group_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(users.participation(stream(spark, sf_dir), "user_id", "event_type", {"look": ["Click", "view"], "buy": ["PURCHASE"]}))


@register("feature_summary", f"WITH {STREAM} SELECT user_id, round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(coalesce(stddev_samp(score), 0), 6) AS score_std, round(avg(value), 6) AS value_mean, round(max(value), 6) AS value_max, round(coalesce(stddev_samp(value), 0), 6) AS value_std FROM stream GROUP BY user_id")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(users.feature_summary(stream(spark, sf_dir), "user_id", ["score", "value"]))


@register("user_sequences", f"WITH {STREAM}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS r FROM stream), s AS (SELECT user_id, array_agg(event_id ORDER BY t, event_id) FILTER (r <= 64) AS l, max(label) AS y FROM r GROUP BY user_id) SELECT user_id, list_resize(l, 64, 0) AS items, list_resize(list_transform(l, lambda x: true), 64, false) AS mask, CAST(y AS BIGINT) AS y FROM s")
def user_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.sequences(stream(spark, sf_dir), "user_id", "t", "event_id", "label")


@register("user_documents", "SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS digest, count(*) AS n_posts FROM conversations GROUP BY conv_id")
def user_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("tie", F.col("turn"))
    return users.documents_of(c, "conv_id", "text", "turn", "tie").select("conv_id", F.md5("document").alias("digest"), "n_posts")


@register("first_crossing", f"WITH {NUMBERED}, f AS (SELECT user_id, min(CASE WHEN score >= 0.9::DOUBLE THEN k END) AS c, count(*) AS n FROM k GROUP BY user_id) SELECT user_id, CAST(c IS NOT NULL AS BIGINT) AS decision, coalesce(c, n) AS latency FROM f")
def first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return early.first_crossing(stream(spark, sf_dir), "user_id", "score", "t", "event_id", 0.9)


DECIDED = NUMBERED + """, i AS (SELECT *, score >= 0.2::DOUBLE AS hit, k - row_number() OVER (PARTITION BY user_id, score >= 0.2::DOUBLE ORDER BY k) AS isl FROM k), z AS (SELECT *, row_number() OVER (PARTITION BY user_id, hit, isl ORDER BY k) AS run FROM i),
dec AS (SELECT user_id, CAST(max(label) AS BIGINT) AS true_label, CAST(min(CASE WHEN hit AND run >= 2 THEN k END) IS NOT NULL AS BIGINT) AS predicted_label, coalesce(min(CASE WHEN hit AND run >= 2 THEN k END), count(*)) AS posts_seen, count(*) AS n_posts_total FROM z GROUP BY user_id)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return early.decisions(stream(spark, sf_dir), "user_id", "score", "label", "t", "event_id", 0.2, 2)


@register("streak_decision", f"WITH {DECIDED} SELECT * FROM (SELECT user_id, true_label, predicted_label, posts_seen, n_posts_total FROM dec)")
def streak_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir)


TPC = "true_label = 1 AND predicted_label = 1"


def _erde(o: int) -> str:
    return f"avg(CASE WHEN true_label = 0 AND predicted_label = 1 THEN pr WHEN true_label = 1 AND predicted_label = 0 THEN 1 WHEN {TPC} THEN 1 - 1 / (1 + exp(least(700, posts_seen - {o}))) ELSE 0 END)"


def _at(k: int) -> str:
    return f"round(sum(CAST({TPC} AND posts_seen <= {k} AS INT)) / nullif(sum(CAST(predicted_label = 1 AND posts_seen <= {k} AS INT)), 0), 6) AS p_at_{k}"


@register("erisk_report", f"""WITH {DECIDED}, q AS (SELECT *, (SELECT avg(true_label) FROM dec) AS pr FROM dec), r AS (SELECT count(*) AS n_users, CAST(sum(true_label) AS BIGINT) AS n_positive_users, CAST(sum(CAST({TPC} AS INT)) AS BIGINT) AS tp, CAST(sum(CAST(true_label = 0 AND predicted_label = 1 AS INT)) AS BIGINT) AS fp,
 CAST(sum(CAST(true_label = 1 AND predicted_label = 0 AS INT)) AS BIGINT) AS fn, CAST(sum(CAST(true_label = 0 AND predicted_label = 0 AS INT)) AS BIGINT) AS tn, round({_erde(5)}, 6) AS erde_5, round({_erde(50)}, 6) AS erde_50, coalesce(greatest(0, 1 - quantile_cont(posts_seen, 0.5) FILTER ({TPC}) / max(n_posts_total)), 0) AS sp, {_at(1)}, {_at(5)}, {_at(10)} FROM q)
SELECT n_users, n_positive_users, tp, fp, fn, tn, erde_5, erde_50, round(sp, 6) AS speed, p_at_1, p_at_5, p_at_10, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round({F1}, 6) AS f1, round({F1} * sp, 6) AS f_latency FROM r""")
def erisk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(early.report(decided(spark, sf_dir)))


@register("latency_weighted_f1", f"WITH {DECIDED}, r AS (SELECT sum(CAST({TPC} AS INT)) AS tp, sum(CAST(true_label = 0 AND predicted_label = 1 AS INT)) AS fp, sum(CAST(true_label = 1 AND predicted_label = 0 AS INT)) AS fn, coalesce(1 - quantile_cont(-1 + 2 / (1 + exp(-0.0078::DOUBLE * (posts_seen - 1))), 0.5) FILTER ({TPC}), 0) AS speed, CAST(quantile_cont(posts_seen, 0.5) FILTER ({TPC}) AS DOUBLE) AS median_latency FROM dec) SELECT round({F1}, 6) AS f1, round(speed, 6) AS speed, median_latency, round({F1} * speed, 6) AS latency_weighted_f1 FROM r")
def latency_weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(early.latency_weighted_f1(decided(spark, sf_dir)))


def temperature_sql(rounds: int = 4, points: int = 24) -> str:
    """The grid of each round as tables: losses, the best place, and the bounds of the next grid."""
    parts = ["b0 AS (SELECT ln(0.05) AS a, ln(20.0) AS b)"]
    for r in range(1, rounds + 1):
        parts += [
            f"g{r} AS (SELECT i, exp(a + (b - a) * i / {points - 1}) AS t FROM b{r - 1}, range(0, {points}) AS x(i))",
            f"l{r} AS (SELECT i, t, sum(n * (greatest(m, 0) + ln(1 + exp(-abs(m))))) AS l FROM (SELECT i, t, n, z / t * (1 - 2 * y) AS m FROM g{r}, base) GROUP BY i, t)",
            f"m{r} AS MATERIALIZED (SELECT i, t FROM l{r} ORDER BY l, t LIMIT 1)",
            f"b{r} AS MATERIALIZED (SELECT (SELECT ln(t) FROM g{r} WHERE i = (SELECT greatest(0, i - 1) FROM m{r})) AS a, (SELECT ln(t) FROM g{r} WHERE i = (SELECT least({points - 1}, i + 1) FROM m{r})) AS b)",
        ]
    clip = lambda x: f"least(greatest({x}, 1e-6), 1 - 1e-6)"
    error = lambda s: f"(SELECT sum(n * abs(acc - conf)) / sum(n) FROM (SELECT count(*) AS n, avg(y) AS acc, avg({s}) AS conf FROM rows GROUP BY least(9, CAST(floor({s} * 10) AS INT))))"
    return f"""
WITH {LABELLED}, base AS MATERIALIZED (SELECT ln({clip("score")} / (1 - {clip("score")})) AS z, y, count(*) AS n FROM labelled GROUP BY ALL), {", ".join(parts)},
rows AS (SELECT y, score, 1 / (1 + exp(-ln({clip("score")} / (1 - {clip("score")})) / t)) AS after FROM labelled, m{rounds})
SELECT round({error("score")}, 6) AS ece, round({error("after")}, 6) AS ece_after, round((SELECT t FROM m{rounds}), 6) AS temperature"""


@register("temperature_fit", temperature_sql())
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    t = stats.fit_temperature(rows)
    after = metrics.calibration_error(rows.withColumn("score", stats.apply_temperature(F.col("score"), t))).select(F.col("ece").alias("ece_after"))
    return rounded(metrics.calibration_error(rows).join(after).withColumn("temperature", F.lit(t)))


def drawn_sql(draws: int, seed: int = 42) -> str:
    """Labelled rows by draw, each with its weight."""
    digits = f"substr(md5('{seed}|' || doc_id || '|' || draw), 1, 10)"
    return f"drawn AS (SELECT *, " + " + ".join(f"CAST({digits} >= '{b}' AS BIGINT)" for b in stats.poisson_bounds()) + f" AS w FROM labelled, range(1, {draws + 1}) AS r(draw))"


@register("bootstrap_ci", f"""WITH {LABELLED}, {drawn_sql(500)}, f AS (SELECT draw, coalesce(2.0::DOUBLE * sum(w) FILTER (y = 1 AND pred = 1) / nullif(2 * coalesce(sum(w) FILTER (y = 1 AND pred = 1), 0) + coalesce(sum(w) FILTER (y = 0 AND pred = 1), 0) + coalesce(sum(w) FILTER (y = 1 AND pred = 0), 0), 0), 0) AS f1 FROM drawn GROUP BY draw)
SELECT (SELECT round(coalesce(2.0::DOUBLE * count(*) FILTER (y = 1 AND pred = 1) / nullif(sum(y) + sum(pred), 0), 0), 6) FROM labelled) AS point, round(quantile_cont(f1, 0.025), 6) AS lo, round(quantile_cont(f1, 0.975), 6) AS hi FROM f""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.bootstrap_f1(labelled(spark, sf_dir), "doc_id", "y", "pred"))


@register("paired_bootstrap", f"""WITH {LABELLED}, {drawn_sql(2000)}, e AS (SELECT draw, CAST(sum((CAST(pred = y AS BIGINT) - CAST(pred_b = y AS BIGINT)) * w) AS DOUBLE) / nullif(sum(w), 0) AS delta FROM drawn GROUP BY draw)
SELECT round(avg(delta), 6) AS delta, round(quantile_cont(delta, 0.025), 6) AS lo, round(quantile_cont(delta, 0.975), 6) AS hi, round(least(1, 2 * least(avg(CASE WHEN delta <= 0 THEN 1 ELSE 0 END), avg(CASE WHEN delta >= 0 THEN 1 ELSE 0 END))), 6) AS p FROM e""")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.paired_bootstrap(labelled(spark, sf_dir), "doc_id", "y", "pred", "pred_b"))


@register("label_correlation_profile", f"WITH {LABELLED}, t AS (SELECT source, y, text, {TOKENS} AS toks FROM labelled), r AS (SELECT source, y, {hits(PROBE.anxiety_terms)} / greatest(1, len(toks)) AS rate FROM t) SELECT source, round(avg(rate), 6) AS mean_rate, round(coalesce(CASE WHEN stddev_pop(rate) > 0 AND stddev_pop(y) > 0 THEN corr(rate, y) END, 0), 6) AS r, count(*) AS n FROM r GROUP BY source HAVING count(*) >= 5")
def label_correlation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = labelled(spark, sf_dir).select("source", F.col("y").cast("double").alias("y"), T.tokens(F.col("text")).alias("w"))
    rate = wide.select("source", "y", (T.token_hits(F.col("w"), PROBE.anxiety_terms) / F.greatest(F.lit(1), F.size("w"))).alias("rate"))
    # Correlation by hand: 0 where either side has no spread.
    spread = F.stddev_pop("rate") * F.stddev_pop("y")
    agg = rate.groupBy("source").agg(F.avg("rate").alias("mean_rate"), F.coalesce(F.try_divide(F.covar_pop("rate", "y"), spread), F.lit(0.0)).alias("r"), F.count("*").alias("n"))
    return rounded(agg.where("n >= 5"))


@register("standardised_features", f"WITH {LABELLED}, s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM labelled WHERE quality = 1) SELECT doc_id, round((n_chars - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 6) AS n_chars FROM labelled, s")
def standardised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return rounded(models.standardise(rows, rows.where("quality = 1"), ["n_chars"]).select("doc_id", "n_chars"))


@register("class_weights", f"WITH {LABELLED}, n AS (SELECT y, count(*) AS n FROM labelled GROUP BY y) SELECT y, round(sum(n) OVER () / (2 * n), 6) AS weight, round((1 - 0.999::DOUBLE) / (1 - pow(0.999::DOUBLE, n)), 6) AS effective FROM n")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.balanced_weights(labelled(spark, sf_dir), "y")
    return rounded(rows.groupBy("y").agg(F.max("weight").alias("weight"), models.effective_number_weight(F.count("*")).alias("effective")))


def featured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    wide = labelled(spark, sf_dir).withColumn("w", T.tokens(F.col("text")))
    cols = T.feature_columns(F.col("text"), F.col("w"), PROBE, ("lexical", "pronoun", "certainty", "length"))
    return wide.select("doc_id", "y", "source", *[c.cast("double").alias(n) for n, c in cols.items()]), list(cols)


@register("tfidf_logreg_scores")
def tfidf_logreg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("doc_id", "text", "y")
    fitted = models.build_model("tfidf", min_df=3, size=20_000).fit(splits.folds(rows, "doc_id").where("fold <> 0").drop("fold"))
    return rounded(fitted.score(rows).select("doc_id", "score", "pred"))


@register("gbt_scores")
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = featured(spark, sf_dir)
    return rounded(models.build_model("gbt", features=names, maxIter=8).fit(rows).score(rows).select("doc_id", "score", "pred"))


@register("out_of_fold_scores")
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = featured(spark, sf_dir)
    return rounded(models.out_of_fold(rows, lambda: models.build_model("elastic", features=names), "doc_id", 3).select("doc_id", "fold", "score"))


@register("ordinal_levels")
def ordinal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = featured(spark, sf_dir)
    return models.ordinal(stored(rows.withColumn("lv", F.col("doc_id") % 3)), names, "lv", 3).select("doc_id", "lv", "level")


def flips_sql(name: str) -> str:
    """Decisions over the words of a text and of its perturbed form."""
    share = lambda t: f"(SELECT {hits(PROBE.anxiety_terms)} / greatest(1, len(toks)) FROM (SELECT {TOKENS.replace('lower(text)', f'lower({t})')} AS toks))"
    return f"SELECT round(avg(CASE WHEN (a >= 0.1) <> (b >= 0.1) THEN 1 ELSE 0 END), 6) AS flip_rate, round(avg(abs(a - b)), 6) AS mean_abs_drift, '{name}' AS perturbation FROM (SELECT {share('text')} AS a, {share('other')} AS b FROM (SELECT text, {perturbed_sql(name)} AS other FROM documents))"


@register("robustness_flips", " UNION ALL ".join(flips_sql(n) for n in perturb.PERTURBATIONS))
def robustness_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a lexicon decision flips when texts are perturbed."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    share = lambda w: T.token_hits(w, PROBE.anxiety_terms) / F.greatest(F.lit(1), F.size(w))
    names = ("text", *perturb.PERTURBATIONS)
    # Each form of a text is cut into words once; all decisions come out of one pass over the texts.
    words = T.once(perturb.all_perturbed(rows, "text", "doc_id").select(*names), **{f"w_{n}": T.tokens(F.col(n)) for n in names})
    scores = T.once(words.select(*[f"w_{n}" for n in names]), **{f"s_{n}": share(F.col(f"w_{n}")) for n in names})
    forms = F.array(*[F.struct(F.lit(n).alias("perturbation"), F.col("s_text").alias("a"), F.col(f"s_{n}").alias("b")) for n in perturb.PERTURBATIONS])
    both = scores.select(F.inline(forms)).withColumns({"pa": (F.col("a") >= 0.1).cast("int"), "pb": (F.col("b") >= 0.1).cast("int")})
    named = spark.createDataFrame([(n,) for n in perturb.PERTURBATIONS], "perturbation string")  # without texts there is a row for each all the same
    return rounded(named.join(metrics.flip_rate(both, "pa", "pb", "a", "b", ("perturbation",)), "perturbation", "left").select("flip_rate", "mean_abs_drift", "perturbation"))


@register("embedding_centroid_cosine", "WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY label, i) SELECT vec_id, round(sum(v * m) / (sqrt(sum(CAST(v AS DOUBLE) * v)) * sqrt(sum(m * m))), 5) AS cosine FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY vec_id")
def embedding_centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with its label's mean. Means come from partial sums by place, and go back as one array per label."""
    e = table(spark, sf_dir, "embeddings")
    places = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = places.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    both = e.join(centre, "label")
    return rounded(both.select("vec_id", (dot("embedding", "c") / F.sqrt(dot("embedding", "embedding")) / F.sqrt(dot("c", "c"))).alias("cosine")), 5)


@register("stream_tumbling", "WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total FROM e, w WHERE start + INTERVAL 1 DAY <= mark")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.run_to_table(E.tumbling_counts(E.read_events(spark, f"{sf_dir}/events.parquet"), "1 day"), E.working_folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("stream_early_decision", f"WITH {DECIDED} SELECT user_id, predicted_label, posts_seen FROM dec WHERE predicted_label = 1")
def stream_early_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = E.read_events(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", F.least(F.col("value") / 500.0, F.lit(1.0)).alias("score"))
    return E.run_to_table(E.early_decisions(scores, 0.2, 2), E.working_folder(spark))


@register("stream_distinct", "SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.read_events(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type")
    return E.run_to_table(E.distinct(rows, ["user_id", "event_type"]), E.working_folder(spark)).select("user_id", "event_type")


SESSIONS_SQL = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
w AS (SELECT max(ts) - INTERVAL 6 HOUR AS mark FROM events)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, count(*) AS n FROM s, w GROUP BY user_id, s, mark HAVING max(ts) + INTERVAL 6 HOUR <= mark
"""


@register("stream_sessions", SESSIONS_SQL)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.run_to_table(E.sessions(E.read_events(spark, f"{sf_dir}/events.parquet")), E.working_folder(spark))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
