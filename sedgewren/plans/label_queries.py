"""Queries of labels, duplicates, cohorts, audits and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, cohort, dedup, labels, language, names, splits, threads
from ..operators.preprocess import preprocess
from ..schemas import TARGETS
from ..sources import corpora, files
from .adapters import LABELLED, POSTS, PRIORS, PROBE, STREAM, TOKENS, hits, labelled, per_hundred, phrases, posts, priors, rounded, stream
from .catalog import register, table
from .text_queries import REDACT, language_sql

PRIOR_SQL = "priors(name, p1, p2, p3, p4) AS (VALUES " + ", ".join(str((n.lower(), *v)) for n, *v in PRIORS) + ")"
SCORES_SQL = f"""t AS (SELECT doc_id, source, text, {TOKENS} AS toks FROM documents), n AS (SELECT *, greatest(1, len(toks)) AS n FROM t),
lex AS (SELECT doc_id, source, text, {per_hundred(hits(PROBE.anxiety_terms) + ' + ' + phrases(PROBE.anxiety_phrases))} AS l1, {per_hundred(hits(PROBE.health_terms) + ' + ' + phrases(PROBE.health_phrases) + ' + ' + phrases(PROBE.reassurance) + ' // 2')} AS l2,
  {per_hundred(hits(PROBE.depression_terms))} AS l3, {per_hundred(hits(PROBE.suicidality_terms))} AS l4 FROM n),
weak AS (SELECT doc_id, source, text, """ + ", ".join(f"CAST(0.5 AS DOUBLE) * coalesce(CAST(p{i} AS DOUBLE), 0) + CAST(0.5 AS DOUBLE) * l{i} AS weak_{t}" for i, t in enumerate(TARGETS, 1)) + " FROM lex LEFT JOIN priors ON lower(source) = name)"


@register("weak_labels", f"WITH {PRIOR_SQL}, {SCORES_SQL} SELECT doc_id, " + ", ".join(f"round(weak_{t}, 6) AS weak_{t}, CAST(round(weak_{t}, 12) >= {labels.THRESHOLDS[t]} AS BIGINT) AS weak_{t}_bin" for t in TARGETS) + " FROM weak")
def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.weak_labels(table(spark, sf_dir, "documents"), priors(spark), "text", "source", PROBE)
    return rounded(found.select("doc_id", *[c for t in TARGETS for c in (f"weak_{t}", f"weak_{t}_bin")]))


@register("label_precedence", f"WITH {POSTS} SELECT doc_id, round(CASE WHEN quality IS NOT NULL AND lang = 'en' THEN quality WHEN toxic = 1 THEN 1 ELSE score END, 6) AS label_x, CASE WHEN quality IS NOT NULL AND lang = 'en' THEN 'manual' WHEN toxic = 1 THEN 'disclosure' ELSE 'weak' END AS label_x_source, CAST(CASE WHEN quality IS NOT NULL AND lang = 'en' THEN 1.0 WHEN toxic = 1 THEN 0.85 ELSE 0.4 END AS DOUBLE) AS label_x_weight FROM posts WHERE score >= 0.15 OR (quality IS NOT NULL AND lang = 'en') OR toxic = 1")
def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir).withColumns({"manual_x": F.when(F.col("lang") == "en", F.col("quality")), "disclosure_x": F.col("toxic"), "weak_x": F.when(F.col("score") >= 0.15, F.col("score"))})
    return rounded(labels.aggregate_labels(p, "x").select("doc_id", "label_x", "label_x_source", "label_x_weight"))


DIGEST = r"md5(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"


@register("exact_dedup_keep_first", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY {DIGEST} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "source")


SIG_SQL = r"""w AS (SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents),
h AS (SELECT doc_id, source, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h FROM w),
b AS (SELECT doc_id, source, """ + ", ".join(f"sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) AS b{i}" for i in range(64)) + """ FROM h GROUP BY doc_id, source),
s AS (SELECT d.doc_id, d.source, coalesce(""" + " + ".join(f"CASE WHEN b{i} > 0 THEN CAST({1 << i} AS UBIGINT) ELSE CAST(0 AS UBIGINT) END" for i in range(64)) + """, 0) AS sig FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id)"""


@register("simhash_signature", f"WITH {SIG_SQL} SELECT doc_id, CAST(sig AS VARCHAR) AS sig FROM s")
def simhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dedup.signatures(table(spark, sf_dir, "documents"), "doc_id", "text")
    return s.select("doc_id", F.conv(F.hex("sig"), 16, 10).alias("sig"))


@register("near_dup_pairs", f"WITH {SIG_SQL} SELECT a.source, a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.sig, b.sig)) AS BIGINT) AS distance FROM s a JOIN s b ON a.source = b.source AND a.doc_id < b.doc_id WHERE bit_count(xor(a.sig, b.sig)) <= 5")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(dedup.signatures(table(spark, sf_dir, "documents"), "doc_id", "text", ("source",)), "doc_id", "source")


def greedy_sql(ids: str, rows: str, signatures: str) -> str:
    """Tables up to ``gone``: the ids, in one list, that a pass in order drops since an earlier one that is near was not dropped."""
    return f"""near_pairs AS (SELECT a.{ids} AS a, b.{ids} AS b FROM {signatures} a JOIN {signatures} b ON a.{rows} = b.{rows} AND a.{ids} < b.{ids} WHERE bit_count(xor(a.sig, b.sig)) <= 5),
turns AS MATERIALIZED (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM near_pairs GROUP BY b),
pass(i, ids) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT t.i, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(ids, x))) > 0 THEN list_append(ids, b) ELSE ids END FROM pass p JOIN turns t ON t.i = p.i + 1),
gone AS (SELECT unnest(arg_max(ids, i)) AS id FROM pass)"""


@register("near_dup_links", f"WITH {SIG_SQL}, c AS (SELECT source, sig, min(doc_id) AS first FROM s GROUP BY source, sig) SELECT a.source, least(a.first, b.first) AS a, greatest(a.first, b.first) AS b, CAST(bit_count(xor(a.sig, b.sig)) AS BIGINT) AS distance FROM c a JOIN c b ON a.source = b.source AND a.first < b.first WHERE bit_count(xor(a.sig, b.sig)) <= 5 UNION ALL SELECT s.source, first, doc_id, 0 FROM s JOIN c ON s.source = c.source AND s.sig = c.sig WHERE doc_id <> first")
def near_dup_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_links(dedup.signatures(table(spark, sf_dir, "documents"), "doc_id", "text", ("source",)), "doc_id", "source")


@register("near_dedup_greedy", f"WITH RECURSIVE {SIG_SQL}, {greedy_sql('doc_id', 'source', 's')} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT id FROM gone)")
def near_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy_near_dedup(table(spark, sf_dir, "documents"), "doc_id", "source", "text").select("doc_id", "source")


@register("merge_and_dedupe", f"WITH u AS (SELECT 0 AS s, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark) SELECT doc_id, CAST(s AS BIGINT) AS s FROM (SELECT *, row_number() OVER (PARTITION BY {DIGEST} ORDER BY s, doc_id) AS n FROM u) WHERE n = 1")
def merge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("s", F.lit(0).cast("long"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text").withColumn("s", F.lit(1).cast("long"))
    return dedup.merge_and_dedupe([a, b], "text", "doc_id").select("doc_id", "s")


@register("corpus_stats", f"WITH {LABELLED} SELECT count(*) AS n_posts, count(DISTINCT source) AS n_communities, count(DISTINCT lang) AS n_authors, min(n_chars) AS first, max(n_chars) AS last, round(avg(length(text)), 6) AS mean_length, CAST(quantile_cont(length(text), 0.5) AS DOUBLE) AS median_length FROM posts")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.corpus_stats(posts(spark, sf_dir), "text", "source", "lang", "n_chars"))


@register("tier_counts", f"WITH {POSTS}, u AS (SELECT 'quality' AS tier, quality AS v FROM posts UNION ALL SELECT 'toxic', toxic FROM posts UNION ALL SELECT 'score', score FROM posts) SELECT tier, count(v) AS n, CAST(sum(CASE WHEN v >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS positives, round(sum(CASE WHEN v >= 0.5 THEN 1 ELSE 0 END) / count(*), 6) AS share FROM u GROUP BY tier")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.tier_counts(posts(spark, sf_dir), ("quality", "toxic", "score")))


@register("community_breakdown_topn", f"WITH {POSTS} SELECT source, count(*) AS n_posts, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS quality, CAST(sum(coalesce(toxic, 0)) AS BIGINT) AS toxic, CAST(sum(coalesce(quality, 0)) + sum(coalesce(toxic, 0)) AS BIGINT) AS total FROM posts GROUP BY source ORDER BY total DESC, source LIMIT 10")
def community_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.community_breakdown(posts(spark, sf_dir), "source", ("quality", "toxic"))


FLAGS = {"click": "d_click", "late": "d_late"}
#: Flags of events that stand for disclosures.
FLAGGED = STREAM + ", flagged AS (SELECT *, CAST(event_type = 'purchase' AND user_id % 4 = 0 AS BIGINT) AS d_click, CAST(value > 480 AS BIGINT) AS d_late FROM stream)"


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir).withColumns({"d_click": ((F.col("event_type") == "purchase") & (F.col("user_id") % 4 == 0)).cast("long"), "d_late": (F.col("value") > 480).cast("long")})


USERS_SQL = FLAGGED + """, per AS (SELECT user_id, count(*) AS n, max(d_click) AS click, max(d_late) AS late, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS subreddits FROM flagged GROUP BY user_id),
users AS (SELECT user_id, CAST(click AS BIGINT) AS user_click, CAST(late AS BIGINT) AS user_late, CASE WHEN click + late = 0 THEN 'matched_control' ELSE 'disclosed_' || concat_ws('+', CASE WHEN click = 1 THEN 'click' END, CASE WHEN late = 1 THEN 'late' END) END AS user_group, n AS n_posts, subreddits FROM per)"""


@register("user_stats", f"WITH {USERS_SQL}, l AS (SELECT 'click' AS target, CASE WHEN click = 1 THEN n END AS n FROM per UNION ALL SELECT 'late', CASE WHEN late = 1 THEN n END FROM per) SELECT target, count(n) AS n_users, round(avg(n), 6) AS mean_posts, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_posts, max(n) AS max_posts FROM l GROUP BY target")
def user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.user_stats(flagged(spark, sf_dir), "user_id", FLAGS))


@register("disclosure_summary", f"WITH {FLAGGED}, l AS (SELECT event_type, 'click' AS target, d_click AS hit FROM flagged UNION ALL SELECT event_type, 'late', d_late FROM flagged) SELECT event_type, target, CAST(sum(hit) AS BIGINT) AS n_disclosures, round(avg(hit), 6) AS rate, count(*) AS n_posts FROM l GROUP BY event_type, target")
def disclosure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.disclosure_summary(flagged(spark, sf_dir), "event_type", FLAGS))


@register("user_table", f"WITH {USERS_SQL} SELECT * FROM users")
def user_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.user_table(flagged(spark, sf_dir), "user_id", "event_type", FLAGS)


@register("matched_control_pool", f"WITH {USERS_SQL} SELECT DISTINCT s.user_id, s.event_type FROM stream s JOIN users u ON s.user_id = u.user_id WHERE u.user_group = 'matched_control' AND u.n_posts >= 3")
def matched_control_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.control_pool(flagged(spark, sf_dir), "user_id", "event_type", list(FLAGS.values()))


def matched_sql(target: str, flag: str, seed: int, rounds: int = 6) -> str:
    """Rounds of asks and offers as tables, the last named matched_<target>. On the test tables the last of these rounds has nothing left to match."""
    t, one = target, f"md5('{seed}|' || user_id)"
    edge = f"SELECT user_id, event_type AS c, md5('{seed}|' || user_id || '|' || event_type) AS h"
    parts = [
        f"own_{t} AS MATERIALIZED ({edge} FROM (SELECT DISTINCT user_id, event_type FROM flagged WHERE user_id IN (SELECT user_id FROM flagged WHERE {flag} = 1)))",
        f"free_{t}0 AS MATERIALIZED ({edge} FROM (SELECT DISTINCT s.user_id, s.event_type FROM flagged s JOIN users u ON s.user_id = u.user_id WHERE u.user_group = 'matched_control' AND u.n_posts >= 3))",
        f"need_{t}0 AS MATERIALIZED (SELECT DISTINCT user_id, 2 AS need FROM own_{t})",
    ]
    for r in range(1, rounds + 1):
        p = r - 1
        parts += [
            f"ask_{t}{r} AS MATERIALIZED (SELECT *, sum(need) OVER (PARTITION BY c ORDER BY {one}, user_id) - need AS start FROM (SELECT user_id, need, arg_min(c, h) AS c FROM own_{t} JOIN need_{t}{p} USING (user_id) WHERE c IN (SELECT c FROM free_{t}{p}) GROUP BY user_id, need))",
            f"offer_{t}{r} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {one}, user_id) - 1 AS place FROM (SELECT user_id, arg_min(c, h) AS c FROM free_{t}{p} WHERE c IN (SELECT c FROM ask_{t}{r}) GROUP BY user_id))",
            f"got_{t}{r} AS MATERIALIZED (SELECT a.user_id AS positive, o.user_id AS control, a.c AS community FROM ask_{t}{r} a JOIN offer_{t}{r} o ON a.c = o.c AND o.place >= a.start AND o.place < a.start + a.need)",
            f"need_{t}{r} AS MATERIALIZED (SELECT n.user_id, n.need - coalesce(g.n, 0) AS need FROM need_{t}{p} n LEFT JOIN (SELECT positive, count(*) AS n FROM got_{t}{r} GROUP BY positive) g ON n.user_id = g.positive WHERE n.need > coalesce(g.n, 0))",
            f"free_{t}{r} AS MATERIALIZED (SELECT * FROM free_{t}{p} WHERE user_id NOT IN (SELECT control FROM got_{t}{r}))",
        ]
    return ", ".join(parts) + f", matched_{t} AS (" + " UNION ALL ".join(f"SELECT * FROM got_{t}{r}" for r in range(1, rounds + 1)) + ")"


@register("matched_controls", f"WITH {USERS_SQL}, {matched_sql('late', 'd_late', 42)} SELECT * FROM matched_late")
def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.matched_controls(flagged(spark, sf_dir), "user_id", "event_type", "d_late", list(FLAGS.values()))


@register("test_users", f"WITH {USERS_SQL}, {matched_sql('click', 'd_click', 42)}, {matched_sql('late', 'd_late', 43)} SELECT * FROM users WHERE user_group <> 'matched_control' OR user_id IN (SELECT control FROM matched_click UNION ALL SELECT control FROM matched_late)")
def test_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.test_users(flagged(spark, sf_dir), "user_id", "event_type", FLAGS)


@register("regroup_within_cohort", f"WITH {USERS_SQL}, c AS (SELECT DISTINCT user_id FROM stream WHERE value > 150 UNION SELECT -5) SELECT c.user_id, coalesce(user_click, 0) AS user_click, coalesce(user_late, 0) AS user_late, coalesce(user_group, 'matched_control') AS user_group, coalesce(n_posts, 0) AS n_posts, coalesce(subreddits, '') AS subreddits FROM c LEFT JOIN users u ON c.user_id = u.user_id")
def regroup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flagged(spark, sf_dir)
    members = f.where("value > 150").select("user_id").union(spark.createDataFrame([(-5,)], "user_id long"))
    return cohort.regroup(f, members, "user_id", "event_type", FLAGS)


@register("test_posts", f"WITH {USERS_SQL} SELECT f.event_id, f.user_id, u.user_click, u.user_late, u.user_group, CAST(greatest(d_click, d_late) AS BIGINT) AS is_disclosure_post FROM flagged f JOIN users u ON f.user_id = u.user_id WHERE u.user_group <> 'matched_control'")
def test_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flagged(spark, sf_dir)
    users = cohort.user_table(f, "user_id", "event_type", FLAGS).where("user_group <> 'matched_control'")
    return cohort.test_posts(f, users, "user_id", FLAGS).select("event_id", "user_id", "user_click", "user_late", "user_group", "is_disclosure_post")


@register("held_out_mark", f"WITH {USERS_SQL} SELECT f.event_id, u.user_id IS NOT NULL AS held_out_split FROM flagged f LEFT JOIN (SELECT user_id FROM users WHERE user_late = 1) u ON f.user_id = u.user_id")
def held_out_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flagged(spark, sf_dir)
    return cohort.mark_held_out(f, cohort.disclosed(f, "user_id", ["d_late"]).where("d_late = 1"), "user_id").select("event_id", "held_out_split")


@register("cohort_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cohort_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@register("cohort_anti", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def cohort_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@register("having_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)")
def having_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    many = o.groupBy("o_custkey").count().where("count >= 12").select("o_custkey")
    return o.join(many, "o_custkey", "left_semi").select("o_orderkey")


@register("user_set_operations", "WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 450), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT 'union' AS op, user_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def user_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a, b = e.where("value > 450").select("user_id").distinct(), e.where("event_type = 'purchase'").select("user_id").distinct()
    named = lambda f, n: f.select(F.lit(n).alias("op"), "user_id")
    return named(a.union(b).distinct(), "union").union(named(a.intersect(b), "intersect")).union(named(a.subtract(b), "except"))


@register("upsert_rows", "SELECT doc_id, 'new' AS origin FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'prior' FROM documents d WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("new").alias("origin"))
    return files.upsert(new, table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit("prior").alias("origin")), ["doc_id"])


@register("resume_not_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_not_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.not_yet_done(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@register("thread_dfs", """WITH RECURSIVE c AS (SELECT conv_id, turn, turn - 1 - CAST(turn % 3 = 2 AS BIGINT) AS parent FROM conversations),
walk(conv_id, turn, depth, path) AS (SELECT conv_id, turn, CAST(0 AS BIGINT), lpad(CAST(turn AS VARCHAR), 12, '0') FROM c r WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = r.conv_id AND p.turn = r.parent)
 UNION ALL SELECT c.conv_id, c.turn, w.depth + 1, w.path || '/' || lpad(CAST(c.turn AS VARCHAR), 12, '0') FROM c JOIN walk w ON c.conv_id = w.conv_id AND c.parent = w.turn)
SELECT conv_id, turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS position FROM walk""")
def thread_dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("parent", F.col("turn") - 1 - (F.col("turn") % 3 == 2).cast("long"))
    return threads.depth_first(c, "conv_id", "turn", "parent")


@register("nested_submissions", "SELECT CASE WHEN turn = 0 THEN 'submission' ELSE 'comment' END AS kind, CAST(conv_id * 100 + turn AS VARCHAR) AS item_id, CASE WHEN turn > 0 THEN CAST(conv_id * 100 AS VARCHAR) END AS parent_id, md5(text) AS body FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)")
def nested_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are folded to nested submissions as JSON, and flattened again by the loader."""
    c = table(spark, sf_dir, "conversations")
    i = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    comment = F.struct(i.alias("commentId"), F.lit("a").alias("author"), F.lit("2024-01-01").alias("date"), F.col("text").alias("body"), (F.col("conv_id") * 100).cast("string").alias("parent"))
    own = c.where("turn = 0").select("conv_id", i.alias("submissionId"), F.col("text").alias("body"))
    rest = c.where("turn > 0").groupBy("conv_id").agg(F.collect_list(comment).alias("comments"))
    folded = own.join(rest, "conv_id", "left").select(F.to_json(F.struct("submissionId", F.lit("a").alias("author"), F.lit("2024-01-01").alias("date"), F.lit("t").alias("title"), "body", F.lit(1).alias("number"), F.lit("s").alias("targetSubject"), "comments")).alias("j"))
    element = corpora.SUBMISSIONS[len("array<"):-1]
    flat = corpora.flatten_submissions(folded.select(F.from_json("j", element).alias("s")))
    return flat.select("kind", "item_id", "parent_id", F.md5("body").alias("body"))


@register("canonical_posts", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'erisk' AS subreddit, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE epoch(o_orderdate) END AS created_utc FROM orders WHERE o_orderstatus = 'F'")
def canonical_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderkey") % 5 == 0, "not a date").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = o.select(F.when(F.col("o_orderstatus") == "F", "submission").otherwise("comment").alias("kind"), F.col("o_orderkey").cast("string").alias("item_id"), date.alias("date"), F.lit("t").alias("title"), F.lit("b").alias("body"), F.lit("a").alias("author"))
    return corpora.to_canonical(rows).select("id", "subreddit", "created_utc")


@register("trec_sentences", "SELECT 's' || CAST(item_id AS VARCHAR) AS sentence_id, md5(trim(text, E' \\n\\t\\r')) AS text FROM benchmark")
def trec_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items are written as TREC documents and parsed again."""
    b = table(spark, sf_dir, "benchmark")
    doc = F.concat(F.lit("<DOC>\n<DOCNO> s"), F.col("item_id").cast("string"), F.lit("</DOCNO><PRE>p</PRE>\n<text> "), F.col("text"), F.lit("</TEXT>\n<POST></POST>\n</DOC>"))
    whole = b.select(F.concat(doc, F.lit("\n<DOC>cut off")).alias("value"))
    return corpora.sentences_of(whole, "value").select("sentence_id", F.md5("text").alias("text"))


@register("event_props", "SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return e.select("event_id", "v", "k")


@register("period_rates", "WITH o AS (SELECT epoch(o_orderdate) + 1000000000 AS t, o_orderstatus, CAST(o_totalprice > 150000 AS DOUBLE) AS big FROM orders), p AS (SELECT CASE WHEN t <= 1583884800 THEN 'pre' WHEN t <= 1651363200 THEN 'pandemic' ELSE 'post' END AS period, * FROM o) SELECT period, o_orderstatus, count(*) AS n, round(avg(big), 6) AS rate_big FROM p GROUP BY period, o_orderstatus")
def period_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 1000000000).alias("t"), "o_orderstatus", (F.col("o_totalprice") > 150000).cast("double").alias("big"))
    return rounded(audit.rates_by(o.withColumn("period", T.period(F.col("t"))), ["period", "o_orderstatus"], ["big"]))


@register("community_rates", f"WITH {POSTS} SELECT source, count(*) AS n, round(avg(quality), 6) AS rate_quality, round(avg(toxic), 6) AS rate_toxic FROM posts GROUP BY source")
def community_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.rates_by(posts(spark, sf_dir), ["source"], ["quality", "toxic"]))


@register("month_topk_pivot", "WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(o_custkey % 40 AS VARCHAR) AS sub FROM orders), top AS (SELECT sub FROM o GROUP BY sub ORDER BY count(*) DESC, sub LIMIT 6) SELECT month, coalesce(top.sub, 'other') AS series, count(*) AS n FROM o LEFT JOIN top ON o.sub = top.sub GROUP BY 1, 2")
def month_topk_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_custkey") % 40).cast("string").alias("sub"))
    return audit.top_k_pivot(o, "month", "sub")


@register("phi_matrix", f"WITH {LABELLED} SELECT 'y' AS a, 'pred' AS b, round(corr(y, pred), 6) AS phi FROM labelled UNION ALL SELECT 'y', 'quality', round(corr(y, quality), 6) FROM labelled UNION ALL SELECT 'pred', 'quality', round(corr(pred, quality), 6) FROM labelled UNION ALL SELECT 'y', 'y', round(corr(y, y), 6) FROM labelled UNION ALL SELECT 'pred', 'pred', round(corr(pred, pred), 6) FROM labelled UNION ALL SELECT 'quality', 'quality', round(corr(quality, quality), 6) FROM labelled")
def phi_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.phi_matrix(labelled(spark, sf_dir), ("y", "pred", "quality")))


@register("severity_by_group", f"WITH {POSTS} SELECT source, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(stddev_samp(score), 6) AS std, count(*) AS n FROM posts GROUP BY source")
def severity_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.severity(posts(spark, sf_dir), "source", "score"))


@register("hardest_examples", f"WITH {LABELLED} SELECT doc_id, y, round(score, 6) AS score, round(abs(score - y), 6) AS gap, substr(text, 1, 280) AS preview FROM labelled ORDER BY abs(score - y) DESC, doc_id LIMIT 20")
def hardest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.hardest(labelled(spark, sf_dir), "y", "score", "doc_id").select("doc_id", "y", "score", "gap", F.substring("text", 1, 280).alias("preview")))


@register("capped_sample_per_group", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 12")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.capped_sample(table(spark, sf_dir, "documents"), "source", "doc_id", 12).select("doc_id", "source")


UNIT = "CAST(('0x' || substr(md5('42|' || {k}), 1, 8))::BIGINT AS DOUBLE) / 4294967296"


@register("stratified_split", "WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY " + UNIT.format(k="doc_id") + ", doc_id) AS p, count(*) OVER (PARTITION BY toxic) AS n FROM labels) SELECT doc_id, CASE WHEN p <= round(n * 0.2) THEN 'test' WHEN p <= round(n * 0.2) + round(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "toxic").select("doc_id", "split")


@register("author_disjoint_split", "SELECT event_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.30000000000000004 THEN 'val' ELSE 'train' END AS split FROM (SELECT event_id, " + UNIT.format(k="user_id") + " AS u FROM events)")
def author_disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.group_split(table(spark, sf_dir, "events"), "user_id").select("event_id", "split")


@register("cross_community_split", "SELECT doc_id, CASE WHEN lower(source) IN ('src1', 'src2') THEN 'test' ELSE 'train' END AS split FROM documents")
def cross_community_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.community_split(table(spark, sf_dir, "documents"), "source", ["SRC1", "Src2"]).select("doc_id", "split")


@register("k_folds", "SELECT doc_id, CAST(floor(" + UNIT.format(k="doc_id") + " * 5) AS BIGINT) AS fold FROM documents")
def k_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.folds(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "fold")


@register("held_out_corpus", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY " + UNIT.format(k="doc_id") + ", doc_id LIMIT 100)")
def held_out_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return splits.held_out(d, splits.fixed_sample(d, "doc_id", 100), "doc_id").select("doc_id")


def clean_sql(text: str) -> str:
    """The cleaning of a text, strip by strip."""
    t = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        t = f"replace({t}, '{entity}', '{char}')"
    for pattern, new in ((r"\[([^\]]+)\]\(([^)]+)\)", r"'\1'"), (r"https?://\S+|www\.\S+", "' [URL] '"), (r"(?im)^\*?I am a bot.*$|^\*?This action was performed automatically.*$", "''"), (r"\n{3,}", "chr(10) || chr(10)"), (r"[ \t]{2,}", "' '"), (r"^\s+|\s+$", "''")):
        t = f"regexp_replace({t}, '{pattern}', {new}, 'g')"
    return t


def preprocess_sql() -> str:
    """Clean, filter, redact, pseudonymise; of equal texts the first, then the greedy pass over signatures."""
    return f"""
WITH RECURSIVE c AS (SELECT doc_id AS id, source AS subreddit, 'u_' || substr(sha256('anxiety-research-v1|' || CAST(doc_id % 50 AS VARCHAR)), 1, 12) AS author_hash, {clean_sql("coalesce(text, '')")} AS text FROM documents
  WHERE lower(regexp_replace(coalesce(text, 'x'), '^\\s+|\\s+$', '', 'g')) NOT IN ('[deleted]', '[removed]', '')),
l AS (SELECT *, {language_sql(TOKENS)} AS lang FROM c WHERE length(text) >= 50),
r AS (SELECT id, subreddit, author_hash, lang, {REDACT} AS text FROM l WHERE lang = 'en'),
k AS MATERIALIZED (SELECT id AS doc_id, subreddit AS source, author_hash, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY {DIGEST} ORDER BY id) AS n FROM r) WHERE n = 1),
{SIG_SQL.replace("documents", "k")}, {greedy_sql("doc_id", "source", "s")}
SELECT doc_id AS id, source AS subreddit, lang, author_hash, md5(text) AS digest FROM k WHERE doc_id NOT IN (SELECT id FROM gone)"""


@register("preprocess", preprocess_sql())
def preprocess_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = d.select(F.col("doc_id").alias("id"), F.col("source").alias("subreddit"), F.lit("").alias("title"), F.col("text").alias("body"), (F.col("doc_id") % 50).cast("string").alias("author"))
    return preprocess(raw, near=5, columns=()).select("id", "subreddit", "lang", "author_hash", F.md5("clean_text").alias("digest"))


@register("preprocess_full")
def preprocess_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With languages by profiles that were fitted on this table, and names by the default labeller."""
    d = table(spark, sf_dir, "documents")
    profiles = language.fit_profiles(d, "doc_id", "text", "lang")
    raw = d.select(F.col("doc_id").alias("id"), F.col("source").alias("subreddit"), F.lit("").alias("title"), F.col("text").alias("body"), (F.col("doc_id") % 50).cast("string").alias("author"))
    done = preprocess(raw, near=5, detector=lambda t: language.language_by_profile(t, profiles), tagger=names.default_tagger(), columns=())
    return done.select("id", "subreddit", "lang", "author_hash", F.md5("clean_text").alias("digest"))


BANK = {"anxiety": ("I can't stop worrying.", "My heart is racing."), "depression": ("Everything feels pointless.",), "neutral": ("Today was a regular day.", "I moved to a new city.")}


def synthetic_sql(posts_each: int = 20, seed: int = 42, now: float = 1735689600.0) -> str:
    """A profile for each source from its labels; sentences of each kind are drawn by hashes."""
    u = lambda *parts: f"(CAST('0x' || substr(md5('{seed}|' || name || '|' || i" + "".join(f" || '|' || {x}" for x in parts) + "), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
    pick = lambda kind: f"[{', '.join(chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39) for t in BANK[kind])}][CAST(floor({u(repr('pick'), 'j')} * {len(BANK[kind])}) AS INT) + 1]"
    sentence = f"CASE WHEN {u(repr('kind'), 'j')} < anxiety THEN {pick('anxiety')} WHEN {u(repr('kind'), 'j')} < anxiety + depression THEN {pick('depression')} ELSE {pick('neutral')} END"
    return f"""
WITH {POSTS}, c AS (SELECT source AS name, coalesce(avg(CAST(toxic AS DOUBLE)), 0) AS anxiety, coalesce(avg(1 - CAST(quality AS DOUBLE)), 0) AS depression FROM posts WHERE source IS NOT NULL GROUP BY source),
r AS (SELECT c.*, i FROM c, range(0, {posts_each}) AS x(i)),
b AS (SELECT *, array_to_string(list_transform(range(1, CAST(3 + floor({u(repr('n'))} * 6) AS INT) + 1), lambda j: {sentence}), ' ') AS body FROM r)
SELECT 'syn_' || name || '_' || lpad(CAST(i AS VARCHAR), 5, '0') AS id, name AS subreddit, {now}::DOUBLE - floor({u(repr('t'))} * 94608000) AS created_utc, substr(split_part(body, '.', 1), 1, 80) AS title, body,
       'user_' || CAST(1000 + floor({u(repr('author'))} * 9000) AS BIGINT) AS author, CAST(floor({u(repr('score'))} * 1001) AS BIGINT) AS score, CAST(floor({u(repr('comments'))} * 201) AS BIGINT) AS num_comments FROM b"""


@register("synthetic_posts", synthetic_sql())
def synthetic_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts in the number and by the profiles of the documents' sources."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    profiles = posts(spark, sf_dir).where("source is not null").groupBy(F.col("source").alias("name")).agg(share(F.col("toxic")).alias("anxiety"), share(1 - F.col("quality")).alias("depression"))
    made = corpora.synthetic_posts(spark, profiles, BANK, 20)
    return made.select("id", "subreddit", "created_utc", "title", "body", "author", "score", "num_comments")


@register("audit_markdown", f"WITH {POSTS}, c AS (SELECT lang, count(*) AS n, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic FROM posts GROUP BY lang) SELECT place, line FROM (SELECT 1 AS place, '# Corpus' AS line UNION ALL SELECT 2, '' UNION ALL SELECT 3, '## Languages' UNION ALL SELECT 4, '' UNION ALL SELECT 5, '| lang | n | toxic |' UNION ALL SELECT 6, '|---|---|---|' UNION ALL SELECT 6 + row_number() OVER (ORDER BY lang), '| ' || coalesce(lang, 'None') || ' | ' || n || ' | ' || toxic || ' |' FROM c UNION ALL SELECT 7 + (SELECT count(*) FROM c), '')")
def audit_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's lines: the languages and their labels."""
    figures = posts(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")).orderBy("lang")
    return spark.createDataFrame(list(enumerate(audit.markdown("Corpus", {"Languages": figures}).split("\n"), 1)), "place long, line string")


@register("cache_keys", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS cache_key FROM orders WHERE o_orderstatus <> 'F'""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key is not among the answers that are kept already: those of status F."""
    keyed = table(spark, sf_dir, "orders").withColumn("cache_key", files.cache_key("o_custkey", "o_orderstatus"))
    answers = keyed.where("o_orderstatus = 'F'").select("cache_key")
    return files.not_yet_done(keyed, answers, ["cache_key"]).select("o_orderkey", "cache_key")


@register("flagship", f"""WITH {PRIOR_SQL}, {SCORES_SQL}, {POSTS},
first AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {DIGEST} ORDER BY doc_id) AS n FROM documents) WHERE n = 1),
lab AS (SELECT p.doc_id, p.source, w.weak_anxiety AS s, CASE WHEN p.quality IS NOT NULL THEN p.quality WHEN p.toxic = 1 THEN 1 ELSE w.weak_anxiety END AS label FROM posts p JOIN weak w ON p.doc_id = w.doc_id JOIN first f ON p.doc_id = f.doc_id)
SELECT source, count(*) AS n, round(avg(CASE WHEN label >= 0.5 THEN 1 ELSE 0 END), 6) AS positive_rate, round(avg(s), 6) AS mean_score FROM lab GROUP BY source""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak labels, label precedence, exact dedup, and rates by source, end to end."""
    once = dedup.exact_dedup(posts(spark, sf_dir), "text", "doc_id")
    weak = labels.weak_labels(once, priors(spark), "text", "source", PROBE)
    full = labels.aggregate_labels(weak.withColumns({"manual_anxiety": F.col("quality"), "disclosure_anxiety": F.col("toxic")}), "anxiety")
    return rounded(full.groupBy("source").agg(F.count("*").alias("n"), F.avg((F.col("label_anxiety") >= 0.5).cast("double")).alias("positive_rate"), F.avg("weak_anxiety").alias("mean_score")).orderBy("source"))
