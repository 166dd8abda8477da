"""Queries of filters, lookups and report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, preprocess, reports, users
from ..session import small
from .adapters import LABELLED, POSTS, STREAM, labelled, posts, rounded, stream
from .catalog import register, table
from .eval_queries import BEST, CONF, F1, sweep


@register("collection_filters", "SELECT o_orderkey FROM orders WHERE (o_orderstatus <> 'O' OR o_orderpriority LIKE '1%') AND o_totalprice >= 50000 AND length(o_orderpriority) >= 5")
def collection_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "submission").otherwise("comment").alias("kind"), F.col("o_orderpriority").startswith("1").alias("is_self"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("body"))
    return o.where(preprocess.passes_filters(50000, 5)).select("o_orderkey")


@register("present_bodies", "WITH b AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' [deleted] ' WHEN '2-HIGH' THEN '[REMOVED]' WHEN '3-MEDIUM' THEN '  ' WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS body FROM orders) SELECT o_orderkey FROM b WHERE body IS NULL OR lower(trim(body)) NOT IN ('[deleted]', '[removed]', '')")
def present_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    body = F.when(p == "1-URGENT", " [deleted] ").when(p == "2-HIGH", "[REMOVED]").when(p == "3-MEDIUM", "  ").when(p == "5-LOW", F.lit(None)).otherwise(p)
    return table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")).where(preprocess.present(F.col("body"))).select("o_orderkey")


@register("group_lookup", "WITH g(name, grp) AS (VALUES ('src0', 'main'), ('src1', 'main'), ('src2', 'other')) SELECT doc_id, coalesce(grp, 'baseline') AS grp FROM documents LEFT JOIN g ON lower(source) = name")
def group_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame([("src0", "main"), ("src1", "main"), ("src2", "other")], "name string, grp string")
    return table(spark, sf_dir, "documents").join(small(groups), F.lower("source") == F.col("name"), "left").select("doc_id", F.coalesce("grp", F.lit("baseline")).alias("grp"))


@register("labels_left_join", "SELECT d.doc_id, d.source, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def labels_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(posts(spark, sf_dir).select("doc_id", "source", "quality"))


@register("reindex_fill", "WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY c_nationkey) SELECT CAST(n_nationkey AS BIGINT) AS c_nationkey, coalesce(n, 0) AS n FROM nation LEFT JOIN c ON n_nationkey = c_nationkey")
def reindex_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    keys = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return rounded(reports.reindex(c, keys, "c_nationkey", {"n": 0}))


@register("pseudonym_semi", "WITH h AS (SELECT c_custkey, 'u_' || substr(sha256('anxiety-research-v1|' || c_name), 1, 12) AS author_hash, c_mktsegment FROM customer) SELECT c_custkey, author_hash FROM h WHERE author_hash IN (SELECT author_hash FROM h WHERE c_mktsegment = 'MACHINERY')")
def pseudonym_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    cohort = reports.by_pseudonym(c, "c_name", c.where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("u_"), F.substring(F.sha2(F.concat(F.lit("anxiety-research-v1|"), "c_name"), 256), 1, 12)).alias("author_hash")))
    return cohort.select("c_custkey", "author_hash")


@register("value_counts", f"WITH {POSTS} SELECT CAST(toxic AS BIGINT) AS toxic, count(*) AS n FROM posts GROUP BY toxic")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.value_counts(posts(spark, sf_dir), "toxic"))


@register("label_coverage", f"WITH {POSTS} SELECT round(count(quality) / count(*), 6) AS covered_quality, round(count(lang) / count(*), 6) AS covered_lang FROM posts")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.coverage(posts(spark, sf_dir), ["quality", "lang"]))


@register("corpus_overview", "SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean_length, CAST(quantile_cont(length(text), 0.5) AS DOUBLE) AS median_length FROM documents GROUP BY source")
def corpus_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.overview(table(spark, sf_dir, "documents"), "source", "text"))


@register("length_axis_cut", "SELECT round(quantile_cont(CAST(n_chars AS DOUBLE), 0.99), 6) AS cut FROM documents")
def length_axis_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.axis_cut(table(spark, sf_dir, "documents"), "n_chars"))


@register("group_max_broadcast", f"WITH {STREAM} SELECT event_id, round(max(score) OVER (PARTITION BY user_id), 6) AS user_max FROM stream")
def group_max_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.with_group_max(stream(spark, sf_dir), "user_id", "score", "user_max").select("event_id", "user_max"))


@register("results_pivot", "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY o_orderpriority")
def results_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.pivot_results(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"]), 4)


@register("frozen_operating_point", f"WITH {LABELLED}, k AS (SELECT lang, count(*) AS n, {CONF} FROM labelled GROUP BY lang) SELECT lang, n, round(CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN {F1} END, 6) AS f1, round(CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN tp / (tp + fn) END, 6) AS recall, round((tp + fp) / n, 6) AS positive_rate FROM k")
def frozen_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.frozen_point(labelled(spark, sf_dir), 0.5, "lang"))


@register("stratified_subsample", "WITH q AS (SELECT quality, toxic, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY CAST(('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT AS DOUBLE) / 4294967296, doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n, count(*) OVER () AS total FROM labels) SELECT doc_id, CAST(toxic AS BIGINT) AS toxic FROM q WHERE r <= round(CAST(60 AS DOUBLE) * n / total)")
def stratified_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.stratified_sample(table(spark, sf_dir, "labels"), "toxic", "doc_id", 60).select("doc_id", "toxic"))


@register("user_feature_assembly", f"WITH {STREAM}, a AS (SELECT user_id, avg(score) AS score FROM stream GROUP BY user_id), b AS (SELECT user_id, count(*) AS big FROM stream WHERE value > 400 GROUP BY user_id) SELECT a.user_id, round(a.score, 6) AS score, coalesce(big, 0) AS big FROM a LEFT JOIN b ON a.user_id = b.user_id")
def user_feature_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stream(spark, sf_dir)
    big = s.where("value > 400").groupBy("user_id").agg(F.count("*").alias("big"))
    return rounded(reports.assemble(s, [users.aggregate_scores(s, "user_id", "score", "label").select("user_id", "score"), big], "user_id"))


@register("masked_user_evaluation", f"WITH {STREAM}, u AS (SELECT user_id, round(max(score), 9) AS score, max(label) AS y FROM stream WHERE event_type <> 'purchase' GROUP BY user_id), {sweep('u')} SELECT round(score, 6) AS threshold, round({BEST}, 6) AS f1 FROM c ORDER BY round({BEST}, 12) DESC, score LIMIT 1")
def masked_user_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User scores without the posts that are disclosures themselves."""
    kept = stream(spark, sf_dir).withColumn("is_disclosure_post", (F.col("event_type") == "purchase").cast("long")).where("is_disclosure_post <> 1")
    per = users.aggregate_scores(kept, "user_id", "score", "label", "max").select("user_id", F.round("score", 9).alias("score"), F.col("label").alias("y"))
    return rounded(metrics.best_threshold(per))


@register("user_mean_auroc", f"WITH {STREAM}, u AS (SELECT user_id, round(avg(score), 9) AS score, max(label) AS y FROM stream GROUP BY user_id), {sweep('u')} SELECT round(sum(pos * (below - neg / 2)) / (sum(pos) * sum(neg)), 6) AS auroc FROM c")
def user_mean_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = users.aggregate_scores(stream(spark, sf_dir), "user_id", "score", "label").select("user_id", F.round("score", 9).alias("score"), F.col("label").alias("y"))
    return rounded(metrics.auroc(per))


@register("ordered_report", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END::BIGINT AS place FROM orders GROUP BY 1, 2")
def ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a custom order of categories, then by count."""
    place = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2).cast("long")
    agg = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")).withColumn("place", place)
    return agg.orderBy("place", F.desc("n"), "o_orderpriority")
