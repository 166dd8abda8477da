"""Per-user score summaries, behaviour in time, and sequences."""

from __future__ import annotations



from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hour_of, weekday_of


def numbered(frame: DataFrame, user: str, time: str, tie: str) -> DataFrame:
    """Adds k: a row's place (from 1) in its user's time order, and n: the user's rows."""
    own = Window.partitionBy(user)
    return frame.withColumns({"k": F.row_number().over(own.orderBy(time, tie)), "n": F.count("*").over(own)})


def aggregate_scores(frame: DataFrame, user: str, score: str, label: str, how: str = "mean", top: int = 5) -> DataFrame:
    """(user, score, label): mean, max, or mean of the ``top`` highest scores, with the greatest label."""
    if how == "topk_mean":
        rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(score)))
        kept = frame.withColumn("_r", rank)
        return kept.groupBy(user).agg(F.avg(F.when(F.col("_r") <= top, F.col(score))).alias("score"), F.max(label).alias("label"))
    if how not in ("mean", "max"):
        raise ValueError(f"unknown aggregation {how}")
    return frame.groupBy(user).agg((F.avg if how == "mean" else F.max)(score).alias("score"), F.max(label).alias("label"))


def score_summary(frame: DataFrame, user: str, score: str, time: str, tie: str) -> DataFrame:
    """Order statistics and the course of a user's scores: quantiles, top means, first crossing, slope, recency-weighted mean."""
    wide = numbered(frame, user, time, tie).withColumns({"_down": F.row_number().over(Window.partitionBy(user).orderBy(F.desc(score), tie)), "_s": F.col(score).cast("double")})
    top = lambda m: F.avg(F.when(F.col("_down") <= m, F.col("_s")))
    w = F.exp(-(F.col("n") - F.col("k")) / 5.0)
    return wide.groupBy(user).agg(
        F.avg("_s").alias("s_mean"), F.max("_s").alias("s_max"), F.min("_s").alias("s_min"), F.stddev_pop("_s").alias("s_std"), top(3).alias("s_top3"), top(5).alias("s_top5"),
        F.expr("percentile(_s, 0.9D)").alias("s_p90"), F.expr("percentile(_s, 0.95D)").alias("s_p95"), F.avg((F.col("_s") >= 0.5).cast("double")).alias("s_frac50"), F.avg((F.col("_s") >= 0.7).cast("double")).alias("s_frac70"),
        (F.coalesce(F.min(F.when(F.col("_s") >= 0.5, F.col("k") - 1)), F.count("*")) / F.count("*")).alias("s_first_cross"), F.max_by("_s", "k").alias("s_last"),
        F.coalesce(F.regr_slope(F.col("_s"), (F.col("k") - 1).cast("double")), F.lit(0.0)).alias("s_slope"), (F.sum(w * F.col("_s")) / F.sum(w)).alias("s_recency"), F.count("*").alias("n_posts"),
    )


def behaviour(frame: DataFrame, user: str, time: str, tie: str, community: str) -> DataFrame:
    """Span, pace, gaps, burstiness, share at night and in the evening, and the number of communities. ``time`` is in seconds."""
    t = F.col(time).cast("double")
    wide = frame.withColumns({"_t": t, "_gap": (t - F.lag(t).over(Window.partitionBy(user).orderBy(time, tie))) / 86400.0, "_h": hour_of(F.col(time))})
    agg = wide.groupBy(user).agg(
        F.count("*").alias("n_posts"), ((F.max("_t") - F.min("_t")) / 86400.0).alias("span_days"), F.coalesce(F.avg("_gap"), F.lit(0.0)).alias("ipi_mean"), F.coalesce(F.stddev_pop("_gap"), F.lit(0.0)).alias("ipi_std"),
        F.avg((F.col("_h") < 6).cast("double")).alias("night_frac"), F.avg((F.col("_h") >= 19).cast("double")).alias("evening_frac"), F.countDistinct(F.lower(community)).alias("n_subs"),
    )
    sd, mu = F.col("ipi_std"), F.col("ipi_mean")
    return agg.withColumns({"posts_per_day": F.col("n_posts") / (F.col("span_days") + 1.0), "burstiness": F.when(sd + mu > 0, F.try_divide(sd - mu, sd + mu)).otherwise(0.0)})


def entropy(frame: DataFrame, user: str, value: F.Column, name: str, plus: float = 0.0) -> DataFrame:
    """Natural entropy of a user's values, from counts of counts; ``plus`` is added inside the logarithm."""
    per = frame.select(user, value.alias("v")).where("v is not null").groupBy(user, "v").agg(F.count("*").alias("c"))
    # sum of p ln p with p = c / n needs n: it is the sum of the same groups.
    n = F.sum("c").over(Window.partitionBy(user))
    p = F.col("c") / F.col("n")
    return per.withColumn("n", n).groupBy(user).agg((-F.sum(p * F.log(p + plus))).alias(name))


def entropies(frame: DataFrame, user: str, time: str, community: str) -> DataFrame:
    parts = [entropy(frame, user, hour_of(F.col(time)), "hour_entropy"), entropy(frame, user, weekday_of(F.col(time)), "dow_entropy"), entropy(frame, user, F.lower(community), "sub_entropy", 1e-12)]
    return parts[0].join(parts[1], user, "outer").join(parts[2], user, "outer")


def feature_summary(frame: DataFrame, user: str, features: list[str]) -> DataFrame:
    """Mean, greatest and sample deviation (0 for a single row) of each feature per user."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.max(f).cast("double").alias(f"{f}_max"), F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f"{f}_std")]
    return frame.groupBy(user).agg(*aggs)


def participation(frame: DataFrame, user: str, community: str, groups: dict[str, list[str]]) -> DataFrame:
    """Of each group of communities, the share of a user's rows in it."""
    lower = F.lower(F.col(community))
    return frame.groupBy(user).agg(*[F.avg(lower.isin([s.lower() for s in subs]).cast("double")).alias(f"subgrp_{g}") for g, subs in groups.items()])


def sequences(frame: DataFrame, user: str, time: str, tie: str, label: str, width: int = 64, order: str = "recent", least: int = 1) -> DataFrame:
    """(user, items, mask, y): the last (or first) ``width`` rows in ascending time, padded; the label is the greatest.

    Rows beyond the width are dropped by rank before anything is collected, so a list never exceeds it.
    """
    own = Window.partitionBy(user)
    by = (F.desc(time), F.desc(tie)) if order == "recent" else (F.asc(time), F.asc(tie))
    wide = frame.where(F.col(user).isNotNull()).withColumns({"_r": F.row_number().over(own.orderBy(*by)), "_n": F.count("*").over(own), "_y": F.max((F.coalesce(F.col(label).cast("double"), F.lit(0.0)) >= 0.5).cast("long")).over(own)})
    kept = wide.where((F.col("_r") <= width) & (F.col("_n") >= least))
    lists = kept.groupBy(user).agg(F.sort_array(F.collect_list(F.struct(time, tie))).alias("_l"), F.max("_y").alias("y"))
    items = F.transform("_l", lambda x: x[tie])
    pad = F.greatest(F.lit(0), F.lit(width) - F.size("_l"))
    return lists.select(user, F.concat(items, F.array_repeat(F.lit(0).cast(dict(frame.dtypes)[tie]), pad)).alias("items"), F.concat(F.array_repeat(F.lit(True), F.size("_l")), F.array_repeat(F.lit(False), pad)).alias("mask"), "y")


def documents_of(frame: DataFrame, user: str, text: str, time: str, tie: str) -> DataFrame:
    """A user's texts in time order, joined by spaces."""
    lists = frame.groupBy(user).agg(F.sort_array(F.collect_list(F.struct(time, tie, text))).alias("l"))
    return lists.select(user, F.array_join(F.transform("l", lambda x: x[text]), " ").alias("document"), F.size("l").cast("long").alias("n_posts"))


