"""Queries that go through the sources and sinks: what is written to a shared folder and read back equals the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..session import small
from ..sources import collectors, corpora, files
from ..streaming import events as E
from .adapters import POSTS, posts, rounded
from .catalog import register, table
from .label_queries import clean_sql


@register("parquet_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def parquet_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_parquet(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


@register("parquet_shards", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 <> 1 THEN c_mktsegment END AS c_mktsegment FROM customer")
def parquet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shards, one of which lacks a column, written and read as one table."""
    folder, rows = E.working_folder(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    paths = [f"{folder}/{i}.parquet" for i in range(3)]
    for i, path in enumerate(paths):
        part = rows.where(F.col("c_custkey") % 3 == i)
        files.write_parquet(part.drop("c_mktsegment") if i == 1 else part, path)
    return files.read_shards(spark, paths)


@register("corpus_folder", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def corpus_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder without a combined file: all shards are read."""
    folder, rows = E.working_folder(spark), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    for i in range(2):
        files.write_parquet(rows.where(F.col("s_suppkey") % 2 == i), f"{folder}/shard{i}.parquet")
    return files.read_corpus(spark, folder)


@register("jsonl_rows", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{E.working_folder(spark)}/events"
    files.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    return files.read_jsonl(spark, path, "event_id long, user_id long, event_type string, value double").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@register("jsonl_stream", "SELECT event_id, user_id, event_type FROM events")
def jsonl_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = E.working_folder(spark)
    files.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), f"{folder}/in")
    return E.run_to_table(files.stream_jsonl(spark, f"{folder}/in", "event_id long, user_id long, event_type string"), folder)


@register("json_document", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{E.working_folder(spark)}/report"
    files.dump_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return files.read_json(spark, path, "n_nationkey long, n_name string, n_regionkey long")


@register("csv_report", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{E.working_folder(spark)}/report"
    report = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    files.write_report_csv(report, path)
    return rounded(spark.read.schema("o_orderstatus string, n long, mean double").option("header", "true").csv(path), 4)


@register("dump_communities", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS subreddit, coalesce(text, '') AS body, CAST(n_chars AS BIGINT) AS score FROM documents WHERE lower(source) IN (SELECT lower(source) FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)")
def dump_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the two largest communities, whatever their case, out of a dump of documents."""
    docs = table(spark, sf_dir, "documents")
    dump = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("subreddit"), F.lit(0).alias("created_utc"), F.lit(None).cast("string").alias("title"), F.col("text").alias("selftext"), F.lit("a").alias("author"), F.col("n_chars").alias("score"),
        F.lit(0).alias("num_comments"), F.lit(None).cast("string").alias("permalink"), F.lit(True).alias("is_self"), F.lit(False).alias("over_18"),
    )
    names = docs.where("source is not null").groupBy(F.lower("source").alias("s")).count().orderBy(F.desc("count"), "s").limit(2).collect()
    return files.read_dump(dump, [r.s.upper() for r in names]).select("id", "subreddit", "body", "score")


def saved_pages(spark: SparkSession, sf_dir: str, folder: str) -> list[str]:
    """Documents as saved listing pages of 50 posts, a folder for each source and a file for each page; pages overlap by a post. Returns the sources."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    place = F.row_number().over(Window.partitionBy("source", F.floor(F.col("doc_id") / 1000)).orderBy("doc_id")) - 1
    page = F.format_string("%08d-%02d", F.floor(F.col("doc_id") / 1000), F.floor(F.col("place") / 50))
    post = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("subreddit"), F.col("text").alias("selftext"), F.col("n_chars").alias("score"), F.lit("a").alias("author"), (F.col("doc_id") % 10 != 0).alias("is_self"))
    rows = docs.withColumn("place", place).withColumn("page", page).select("source", "page", post.alias("data"))
    again = rows.where(F.col("data.id").cast("long") % 50 == 1).withColumn("page", F.concat("page", F.lit("-more")))
    child = F.struct(F.when(F.col("data.id").cast("long") % 17 == 0, "t1").otherwise("t3").alias("kind"), "data")
    pages = rows.union(again).groupBy("source", "page").agg(F.to_json(F.struct(F.struct(F.collect_list(child).alias("children")).alias("data"))).alias("value"))
    pages.repartition("source", "page").write.partitionBy("source", "page").text(folder)
    return sorted(r.source for r in docs.select("source").distinct().collect())


PAGES_SQL = "SELECT CAST(doc_id AS VARCHAR) AS id, source AS subreddit, coalesce(text, '') AS body, CAST(coalesce(n_chars, 0) AS BIGINT) AS score FROM documents WHERE source IS NOT NULL AND doc_id % 17 <> 0 AND doc_id % 10 <> 0 AND n_chars >= 100 AND length(coalesce(text, '')) >= 50"


@register("listing_collector", PAGES_SQL)
def listing_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of all sources through the collector: posts of kind t3 that are texts, each id once."""
    folder = f"{E.working_folder(spark)}/pages"
    names = saved_pages(spark, sf_dir, folder)
    found = collectors.make_collector("listing", spark, collectors.Collection(names, least_score=100, least_chars=50), path=folder)
    return found.collect_all().select("id", "subreddit", "body", "score")


@register("listing_stream", PAGES_SQL)
def listing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a stream, written and read back."""
    folder = E.working_folder(spark)
    names = saved_pages(spark, sf_dir, f"{folder}/pages")
    found = collectors.make_collector("listing", spark, collectors.Collection(names, least_score=100, least_chars=50), path=f"{folder}/pages")
    return E.run_to_table(found.stream(), folder).dropDuplicates(["id"]).select("id", "subreddit", "body", "score")


@register("zst_rows", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def zst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as zstd JSON lines and back."""
    path = f"{E.working_folder(spark)}/dump"
    files.write_zst_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    return files.read_zst_jsonl(spark, f"{path}/*.zst", "event_id long, user_id long, event_type string, value double").select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@register("configured_priors", "SELECT doc_id, CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'even' ELSE 'baseline' END AS \"group\", CAST(CAST(substr(source, 4) AS INT) AS DOUBLE) / 100 AS prior_anxiety, CAST(0 AS DOUBLE) AS prior_depression FROM documents WHERE source IS NOT NULL")
def configured_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of all sources as YAML, loaded, and looked up for each document."""
    docs, path = table(spark, sf_dir, "documents"), f"{E.working_folder(spark)}/subreddits"
    number = F.substring("source", 4, 9).cast("int")
    entry = F.concat(F.lit("  - {name: "), "source", F.when(number % 2 == 0, ", group: even").otherwise(""), F.lit(", expected_anxiety_prior: "), (number / 100).cast("string"), F.lit("}"))
    listed = docs.where("source is not null").select("source").distinct().select(entry.alias("e")).agg(F.concat_ws("\n", F.lit("subreddits:"), F.sort_array(F.collect_list("e"))).alias("value"))
    listed.coalesce(1).write.text(path)
    known = config.priors_frame(spark, config.load_communities(path))
    return docs.join(small(known), F.col("source") == F.col("name")).select("doc_id", "group", "prior_anxiety", "prior_depression")


#: Cleaned posts of at least 30 characters from a file for each community; the larger half of the names stands for y = 1.
COMMUNITY_SQL = f"WITH c AS (SELECT source AS subreddit, lang AS author, {clean_sql('text')} AS t FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND text <> '') SELECT subreddit, author, md5(t) AS digest, CAST(subreddit >= 'src15' AS BIGINT) AS y FROM c WHERE length(t) >= 30"


@register("community_csv", COMMUNITY_SQL)
def community_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = E.working_folder(spark)
    docs = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("subreddit"), F.col("lang").alias("author"), F.col("text").alias("post"))
    names = sorted(r.subreddit for r in docs.select("subreddit").distinct().collect())
    for name in names:
        docs.where(F.col("subreddit") == name).write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(f"{folder}/{name}_2018.csv")
    got = corpora.community_csv(spark, folder, [n for n in names if n >= "src15"], [n for n in names if n < "src15"], cap=1 << 40)
    return got.select("subreddit", "author", F.md5("clean_text").alias("digest"), "y")


EXPERT_SQL = f"WITH {POSTS}, c AS (SELECT {clean_sql('text')} AS t, CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 1 ELSE 0 END AS y FROM posts WHERE toxic IS NOT NULL AND text IS NOT NULL AND text <> '') SELECT md5(t) AS digest, CAST(y AS BIGINT) AS y FROM c WHERE length(t) >= 10"


@register("expert_csv", EXPERT_SQL)
def expert_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a gold test set: Anxiety or comorbid counts as positive."""
    folder = E.working_folder(spark)
    kind = F.when(F.col("toxic") == 1, "Anxiety").when(F.col("quality") == 0, "comorbid disorders").otherwise("none")
    posts(spark, sf_dir).where("toxic is not null").select(F.col("text").alias("Text"), kind.alias("multiclass_label")).write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(f"{folder}/test.csv")
    return corpora.expert_csv(spark, folder).select(F.md5("clean_text").alias("digest"), "y")
