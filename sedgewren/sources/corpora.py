"""Loaders of labelled corpora: TREC sentences, nested submissions, per-community CSV, synthetic posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .files import exists

SUBMISSIONS = "array<struct<submissionId: string, author: string, date: string, title: string, body: string, number: long, targetSubject: string, comments: array<struct<commentId: string, author: string, date: string, body: string, parent: string>>>>"
TAGS = ("DOCNO", "PRE", "TEXT", "POST")


def trec_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(sentence_id, pre, text, post, source_file) of each <DOC>; files that are no proper XML are read all the same."""
    files = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"))
    return sentences_of(files, "value").select("sentence_id", "pre", "text", "post", "source_file")


def sentences_of(frame: DataFrame, column: str) -> DataFrame:
    inner = r"\s*".join(rf"<{t}>\s*(.*?)\s*</{t}>" for t in TAGS)
    pattern = rf"(?is)<DOC>\s*{inner}\s*</DOC>"
    groups = [F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(i)) for i in range(1, 5)]
    zipped = frame.withColumn("_z", F.explode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("a", "b", "c", "d"), strict=True)])))
    fields = zipped.schema["_z"].dataType.fieldNames()
    names = ("sentence_id", "pre", "text", "post")
    return zipped.select(*[c for c in frame.columns if c != column], *[F.trim(F.col(f"_z.`{f}`")).alias(n) for f, n in zip(fields, names, strict=True)])


def unique_sentences(frame: DataFrame) -> DataFrame:
    """One row for each sentence id, from the first file by name."""
    first = frame.groupBy("sentence_id").agg(F.min("source_file").alias("source_file"))
    return frame.join(first, ["sentence_id", "source_file"], "left_semi").dropDuplicates(["sentence_id"])


def nested_submissions(spark: SparkSession, path: str) -> DataFrame:
    """A row for each submission and each of its comments. A file whose root is no list is an error."""
    files = spark.read.text(path, wholetext=True)
    bad = files.where(~F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("[")).limit(1).collect()
    if bad:
        raise ValueError("a file of submissions must hold a list")
    return flatten_submissions(files.select(F.explode(F.from_json("value", SUBMISSIONS)).alias("s")))


def flatten_submissions(frame: DataFrame) -> DataFrame:
    """``frame`` has a column s of submissions."""
    own = frame.select(
        F.lit("submission").alias("kind"), F.col("s.submissionId").alias("item_id"), F.col("s.submissionId").alias("submission_id"), F.lit(None).cast("string").alias("parent_id"), F.col("s.author").alias("author"), F.col("s.date").alias("date"),
        F.coalesce("s.title", F.lit("")).alias("title"), F.coalesce("s.body", F.lit("")).alias("body"), F.col("s.number").alias("number"), F.col("s.targetSubject").alias("target_subject"),
    )
    comments = frame.select("s", F.explode("s.comments").alias("c")).select(
        F.lit("comment").alias("kind"), F.col("c.commentId").alias("item_id"), F.col("s.submissionId").alias("submission_id"), F.col("c.parent").alias("parent_id"), F.col("c.author").alias("author"), F.col("c.date").alias("date"),
        F.lit("").alias("title"), F.coalesce("c.body", F.lit("")).alias("body"), F.col("s.number").alias("number"), F.col("s.targetSubject").alias("target_subject"),
    )
    return own.unionByName(comments)


def iso_seconds(date: Column) -> Column:
    """Unix seconds of an ISO-8601 time; 0 if it is none."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(date)).cast("double"), F.lit(0.0))


def to_canonical(frame: DataFrame, kinds: Sequence[str] = ("submission",)) -> DataFrame:
    kept = frame.where(F.col("kind").isin(list(kinds)))
    return kept.select(
        F.col("item_id").cast("string").alias("id"), F.lit("erisk").alias("subreddit"), iso_seconds(F.col("date")).alias("created_utc"), F.coalesce("title", F.lit("")).alias("title"), F.col("body").cast("string").alias("body"), F.col("author").cast("string").alias("author"),
        F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("num_comments"), F.lit("").alias("permalink"), F.lit(True).alias("is_self"), F.lit(False).alias("over_18"), F.lit("erisk").alias("source"), F.lit(0.0).alias("collected_at"),
    )


def community_csv(spark: SparkSession, folder: str, positive: Sequence[str], negative: Sequence[str], year: str = "2018", cap: int = 5000, least: int = 30, seed: int = 42) -> DataFrame:
    """(subreddit, author, clean_text, y) of per-community CSV files; missing files are left out. ``cap`` rows of each are drawn by hash (a sampling operator)."""
    from ..operators.audit import capped_sample

    whole = None
    for name, y in [(s, 1) for s in positive] + [(s, 0) for s in negative]:
        path = f"{folder}/{name}_{year}.csv"
        if not exists(spark, path):
            continue
        part = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path).select("subreddit", "author", "post").withColumn("y", F.lit(y).cast("long"))
        whole = part if whole is None else whole.unionByName(part)
    if whole is None:
        return spark.createDataFrame([], "subreddit string, author string, clean_text string, y long")
    kept = whole.where("post is not null").withColumn("_k", F.concat_ws("|", "author", "post"))
    cleaned = capped_sample(kept, "subreddit", "_k", cap, seed).withColumn("clean_text", clean_text(F.lit(""), F.col("post")))
    return cleaned.where(F.length("clean_text") >= least).select("subreddit", "author", "clean_text", "y")


def expert_csv(spark: SparkSession, folder: str, target: str = "anxiety", least: int = 10) -> DataFrame | None:
    """(clean_text, y) of a gold test set; None without its file."""
    path = f"{folder}/test.csv"
    if not exists(spark, path):
        return None
    frame = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    lower = {c.lower(): c for c in frame.columns}
    text = next((lower[c] for c in lower if c in ("text", "post", "body", "selftext", "sentence")), None)
    if text is None:
        raise ValueError(f"no text column among {frame.columns}")
    if f"{target}_label" in frame.columns:
        y = F.col(f"{target}_label").cast("double").cast("long")
    else:
        many = next((lower[c] for c in lower if "multiclass" in c or c in ("label", "class")), None)
        if many is None:
            raise ValueError(f"no label column among {frame.columns}")
        value = F.lower(F.col(many))
        y = (value.contains(target) | value.contains("comorbid")).cast("long")
    return frame.select(clean_text(F.lit(""), F.col(text)).alias("clean_text"), y.alias("y")).where(F.length("clean_text") >= least)


def synthetic_posts(spark: SparkSession, communities: DataFrame, bank: dict[str, Sequence[str]], per_community: int = 200, seed: int = 42, now: float = 1735689600.0) -> DataFrame:
    """Canonical posts mixed from a bank of sentences by each community's profile.

    ``communities`` has name and a share for each kind of the bank but ``neutral``, which takes the rest. All
    draws are hashes of seed, community and place, so the same seed gives the same posts on any cluster.
    """
    kinds = [k for k in bank if k != "neutral"]

    def u(*parts: Column | str) -> Column:
        key = F.concat_ws("|", F.lit(str(seed)), "name", F.col("i").cast("string"), *[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32)

    rows = communities.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_community - 1))))

    def sentence(j: Column) -> Column:
        r, out, at = u("kind", j.cast("string")), None, F.lit(0.0)
        for kind in kinds:
            at = at + F.col(kind)
            pick = F.get(F.array(*[F.lit(s) for s in bank[kind]]), F.floor(u("pick", j.cast("string")) * len(bank[kind])).cast("int"))
            out = F.when(r < at, pick) if out is None else out.when(r < at, pick)
        rest = F.get(F.array(*[F.lit(s) for s in bank["neutral"]]), F.floor(u("pick", j.cast("string")) * len(bank["neutral"])).cast("int"))
        return out.otherwise(rest) if out is not None else rest

    n = (F.lit(3) + F.floor(u("n") * 6)).cast("int")
    body = F.array_join(F.transform(F.sequence(F.lit(1), n), sentence), " ")
    wide = rows.withColumn("body", body)
    return wide.select(
        F.format_string("syn_%s_%05d", "name", "i").alias("id"), F.col("name").alias("subreddit"), (F.lit(now) - F.floor(u("t") * 86400 * 365 * 3)).alias("created_utc"), F.substring(F.split("body", r"\.")[0], 1, 80).alias("title"), "body",
        F.concat(F.lit("user_"), (F.lit(1000) + F.floor(u("author") * 9000)).cast("string")).alias("author"), F.floor(u("score") * 1001).cast("long").alias("score"), F.floor(u("comments") * 201).cast("long").alias("num_comments"),
        F.lit("").alias("permalink"), F.lit(True).alias("is_self"), F.lit(False).alias("over_18"), F.lit("synthetic").alias("source"), F.lit(now).alias("collected_at"), F.lit("submission").alias("kind"), F.lit(None).cast("string").alias("parent_id"),
    )


def listing_posts(frame: DataFrame, column: str = "data") -> DataFrame:
    """Posts of listing pages (a struct with children of kind t3), one for each id over all pages. The contract of live collection, without its network."""
    posts = frame.select(F.explode(f"{column}.children").alias("c")).where("c.kind = 't3'").select("c.data.*")
    return posts.dropDuplicates(["id"])
