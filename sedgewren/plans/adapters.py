"""The test tables as posts, streams and threads, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import Lexicons
from .catalog import table

#: Frequent words of the test texts, in place of the clinical lists that they hardly use.
PROBE = Lexicons(
    anxiety_terms=("the", "of", "der", "que"), anxiety_phrases=("in the", "of the", "la de"), health_terms=("and", "in", "die", "le"), health_phrases=("and the", "to the"),
    reassurance=("is the", "on the", "it is", "the and"), depression_terms=("to", "a", "mit", "des"), suicidality_terms=("th", "er"), first_singular=("is", "ist"), first_plural=("on", "auf"),
    second_person=("with", "pour"), third_person=("that", "das"), uncertainty=("or", "for", "on a"), certainty=("by", "est", "is a"), body_parts=("ing", "tion"),
)
#: Shares for sources, in the place of communities.
PRIORS = tuple((f"SRC{i}", round(0.05 * i, 2), round(1 - 0.04 * i, 2), round(0.03 * i, 2), 0.1 if i % 2 else 0.0) for i in range(12))

POSTS = """posts AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, ((d.doc_id * 7919) % 1000) / 1000 AS score,
  ((d.doc_id * 104729) % 1000) / 1000 AS score_b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
LABELLED = POSTS + """, labelled AS (SELECT *, CAST(toxic AS BIGINT) AS y, CAST(score >= 0.5 AS BIGINT) AS pred, CAST(score_b >= 0.5 AS BIGINT) AS pred_b FROM posts WHERE toxic IS NOT NULL)"""
STREAM = """stream AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000 AS t, least(value / 500, 1) AS score, CAST(user_id % 5 = 0 AS BIGINT) AS label FROM events)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    wide = docs.join(labels, "doc_id", "left")
    return wide.withColumns({"score": ((F.col("doc_id") * 7919) % 1000) / 1000.0, "score_b": ((F.col("doc_id") * 104729) % 1000) / 1000.0})


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = posts(spark, sf_dir).where("toxic is not null")
    return kept.withColumns({"y": F.col("toxic").cast("long"), "pred": (F.col("score") >= 0.5).cast("long"), "pred_b": (F.col("score_b") >= 0.5).cast("long")})


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("score"), (F.col("user_id") % 5 == 0).cast("long").alias("label"),
    )


def priors(spark: SparkSession) -> DataFrame:
    names = ("anxiety", "health_anxiety", "depression", "suicidality")
    return spark.createDataFrame(list(PRIORS), "name string, " + ", ".join(f"prior_{n} double" for n in names))


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a fixed number of digits, since sums of floats depend on their order."""
    kinds = dict(frame.dtypes)
    return frame.select(*[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c) for c in frame.columns])


def words(items: tuple[str, ...] | list[str]) -> str:
    """A SQL list of literals."""
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


#: Tokens in SQL without Unicode word boundaries.
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_](?:[\p{L}\p{N}_'']*[\p{L}\p{N}_])?')"


def hits(terms: tuple[str, ...], tokens: str = "toks") -> str:
    return f"len(list_filter({tokens}, lambda x: list_contains({words(sorted(set(terms)))}, x)))"


def phrases(terms: tuple[str, ...], text: str = "lower(text)") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{t}') AS BIGINT)" for t in sorted(set(terms))) + ")"


def per_hundred(n_hits: str, n: str = "n") -> str:
    return f"least(CAST(1 AS DOUBLE), ({n_hits}) / greatest(CAST(1 AS DOUBLE), {n} / 100) / 3)"
