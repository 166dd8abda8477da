"""Corpus audit: counts and rates for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small


def corpus_stats(frame: DataFrame, text: str, community: str, author: str, time: str) -> DataFrame:
    return frame.agg(
        F.count("*").alias("n_posts"), F.countDistinct(community).alias("n_communities"), F.countDistinct(author).alias("n_authors"), F.min(time).alias("first"), F.max(time).alias("last"),
        F.avg(F.length(text)).alias("mean_length"), F.expr(f"percentile(length({text}), 0.5D)").alias("median_length"),
    )


def tier_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(tier, n, positives, share) of each score or 0/1 column, from one pass turned to long rows."""
    known = [F.count(c).alias(f"n_{c}") for c in columns]
    positive = [F.sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) >= 0.5).cast("long")).alias(f"p_{c}") for c in columns]
    wide = frame.agg(F.count("*").alias("total"), *known, *positive)
    long = wide.selectExpr("total", f"stack({len(columns)}, " + ", ".join(f"'{c}', n_{c}, p_{c}" for c in columns) + ") as (tier, n, positives)")
    return long.select("tier", "n", "positives", F.try_divide(F.col("positives").cast("double"), F.col("total")).alias("share"))


def community_breakdown(frame: DataFrame, community: str, flags: Sequence[str], top: int = 10) -> DataFrame:
    """The ``top`` communities by all flags (a report's limit), ties by name."""
    agg = frame.groupBy(community).agg(F.count("*").alias("n_posts"), *[F.sum(F.coalesce(F.col(f).cast("long"), F.lit(0))).alias(f) for f in flags])
    total = sum((F.col(f) for f in flags), F.lit(0))
    return agg.withColumn("total", total.cast("long")).orderBy(F.desc("total"), community).limit(top)


def user_stats(frame: DataFrame, user: str, flags: dict[str, str]) -> DataFrame:
    """(target, n_users, mean, median and most rows) of users with each flag; a target without users has a row of its own."""
    per = frame.where(F.col(user).isNotNull()).groupBy(user).agg(F.count("*").alias("n"), *[F.max(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(t) for t, c in flags.items()])
    long = per.selectExpr("n", f"stack({len(flags)}, " + ", ".join(f"'{t}', {t}" for t in flags) + ") as (target, hit)")
    n = F.when(F.col("hit") == 1, F.col("n"))
    return long.groupBy("target").agg(F.count(n).alias("n_users"), F.avg(n).alias("mean_posts"), F.expr("percentile(if(hit = 1, n, null), 0.5D)").alias("median_posts"), F.max(n).alias("max_posts"))


def disclosure_summary(frame: DataFrame, community: str, flags: dict[str, str]) -> DataFrame:
    """(community, target, n_disclosures, rate, n_posts) in long form."""
    long = frame.selectExpr(community, f"stack({len(flags)}, " + ", ".join(f"'{t}', cast({c} as double)" for t, c in flags.items()) + ") as (target, hit)")
    return long.groupBy(community, "target").agg(F.sum(F.coalesce("hit", F.lit(0.0))).cast("long").alias("n_disclosures"), F.avg("hit").alias("rate"), F.count("*").alias("n_posts"))


def warnings(stats: dict[str, float], least_posts: int = 1000, least_positive_users: int = 50) -> list[str]:
    """Rule-based remarks on an audit's figures."""
    found = []
    if stats.get("n_posts", 0) < least_posts:
        found.append(f"only {stats.get('n_posts', 0)} posts")
    for name, value in stats.items():
        if name.startswith("users_") and value < least_positive_users:
            found.append(f"only {value} disclosed users for {name[6:]}")
    return found


def markdown(title: str, sections: dict[str, DataFrame], most: int = 200) -> str:
    """A report of small tables; each is a result of an aggregate, and shows its first ``most`` rows."""
    out = [f"# {title}", ""]
    for name, frame in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
        out += ["| " + " | ".join(str(v) for v in row) + " |" for row in frame.limit(most).collect()]
        out.append("")
    return "\n".join(out)


def rates_by(frame: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Rows and mean of each label by the keys; only groups that occur."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"rate_{c}") for c in labels])


def phi_matrix(frame: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(a, b, phi) for all pairs of 0/1 columns, from one pass."""
    pairs = [(a, b) for i, a in enumerate(labels) for b in labels[i:]]
    wide = frame.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return wide.selectExpr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs)) + ") as (a, b, phi)")


def top_k_pivot(frame: DataFrame, row: str, column: str, k: int = 6) -> DataFrame:
    """(row, column or 'other', n): the k most frequent column values (a chart's limit), all others as one."""
    top = frame.groupBy(column).agg(F.count("*").alias("c")).orderBy(F.desc("c"), column).limit(k).select(F.col(column).alias("_k"))
    named = frame.join(F.broadcast(top), F.col(column) == F.col("_k"), "left")  # k rows
    return named.groupBy(row, F.coalesce(F.col("_k"), F.lit("other")).alias("series")).agg(F.count("*").alias("n"))


def severity(frame: DataFrame, group: str, score: str) -> DataFrame:
    return frame.groupBy(group).agg(F.avg(score).alias("mean"), F.expr(f"percentile({score}, 0.5D)").alias("median"), F.stddev_samp(score).alias("std"), F.count("*").alias("n"))


def hardest(frame: DataFrame, y: str, score: str, tie: str, n: int = 20) -> DataFrame:
    """The n rows whose score is farthest from the label (a report's limit)."""
    return frame.withColumn("gap", F.abs(F.col(score) - F.col(y))).orderBy(F.desc("gap"), tie).limit(n)


def under_cut(frame: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The rows that may be among the first ``n`` of their group by ``order`` (hexadecimal digits of a hash): those up to the beginning of four
    digits in which the n-th stands. Counts of beginnings tell which; so of a large group little more than n rows are ever brought together."""
    head = F.substring(order, 1, 4)
    counts = frame.groupBy(F.col(group).alias("_g"), head.alias("_h")).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_g").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1))
    cuts = counts.withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < n).groupBy("_g").agg(F.max("_h").alias("_cut"))
    return frame.join(small(cuts), frame[group].eqNullSafe(F.col("_g"))).where(head <= F.col("_cut")).drop("_g", "_cut")


def capped_sample(frame: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, chosen by a hash of the key: a sample that does not depend on partitions."""
    marked = frame.withColumn("_o", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_o", key))
    return under_cut(marked, group, "_o", n).withColumn("_r", rank).where(F.col("_r") <= n).drop("_r", "_o")
