"""Early detection: one decision for each user's stream, and its costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import f1_of, ratio
from .users import numbered


def decisions(frame: DataFrame, user: str, score: str, label: str, time: str, tie: str, threshold: float = 0.5, streak: int = 1) -> DataFrame:
    """A row per user: positive at the first post that ends ``streak`` consecutive scores at the threshold or above, else negative after all."""
    wide = numbered(frame, user, time, tie).withColumn("hit", F.col(score) >= threshold)
    island = F.col("k") - F.row_number().over(Window.partitionBy(user, "hit").orderBy("k"))
    # A user's hits with one island number are consecutive; a hit's place in its island is the length of the run it ends.
    runs = wide.withColumn("_i", island).withColumn("_run", F.row_number().over(Window.partitionBy(user, "hit", "_i").orderBy("k")))
    first = F.min(F.when(F.col("hit") & (F.col("_run") >= streak), F.col("k")))
    agg = runs.groupBy(user).agg(first.alias("_k"), F.count("*").alias("n_posts_total"), F.max((F.coalesce(F.col(label).cast("double"), F.lit(0.0)) >= 0.5).cast("long")).alias("true_label"))
    return agg.select(F.col(user).alias("user_id"), "true_label", F.col("_k").isNotNull().cast("long").alias("predicted_label"), F.coalesce("_k", "n_posts_total").cast("long").alias("posts_seen"), F.col("n_posts_total").cast("long"))


def first_crossing(frame: DataFrame, user: str, score: str, time: str, tie: str, threshold: float = 0.5) -> DataFrame:
    """(user, decision, latency) without runs: a single window."""
    agg = numbered(frame, user, time, tie).groupBy(user).agg(F.min(F.when(F.col(score) >= threshold, F.col("k"))).alias("_k"), F.count("*").alias("_n"))
    return agg.select(user, F.col("_k").isNotNull().cast("long").alias("decision"), F.coalesce("_k", "_n").cast("long").alias("latency"))


TP = "true_label = 1 and predicted_label = 1"


def latency_cost(k: Column, o: int) -> Column:
    """Near 0 before ``o`` posts, a half at ``o``, near 1 after; exponents are kept in range."""
    return 1 - 1 / (1 + F.exp(F.least(F.lit(700.0), k.cast("double") - o)))


def erde(frame: DataFrame, o: int, c_fp: float | None = None, c_fn: float = 1.0, c_tp: float = 1.0) -> Column:
    """Aggregate expression; a false positive costs the share of positive users unless given."""
    fp = F.sum(F.expr("if(true_label = 0 and predicted_label = 1, 1, 0)"))
    fn = F.sum(F.expr("if(true_label = 1 and predicted_label = 0, 1, 0)"))
    late = F.sum(F.when(F.expr(TP), latency_cost(F.col("posts_seen"), o)).otherwise(0.0))
    price = F.avg(F.col("true_label").cast("double")) if c_fp is None else F.lit(c_fp)
    return F.try_divide(fp * price + fn * c_fn + late * c_tp, F.count("*").cast("double"))


def speed() -> Column:
    """1 minus the median posts of true positives over the longest history of all users; 0 without any."""
    median = F.expr(f"percentile(if({TP}, posts_seen, null), 0.5D)")
    return F.coalesce(F.greatest(F.lit(0.0), 1 - median / F.greatest(F.max("n_posts_total"), F.lit(1))), F.lit(0.0))


def report(frame: DataFrame) -> DataFrame:
    """All headline figures of a table of decisions, in one aggregate."""
    s = lambda c: F.sum(F.expr(f"if({c}, 1, 0)"))
    at = lambda k: F.try_divide(s(f"{TP} and posts_seen <= {k}").cast("double"), s(f"predicted_label = 1 and posts_seen <= {k}").cast("double"))
    agg = frame.agg(
        F.count("*").alias("n_users"), F.sum("true_label").alias("n_positive_users"), s(TP).alias("tp"), s("true_label = 0 and predicted_label = 1").alias("fp"), s("true_label = 1 and predicted_label = 0").alias("fn"),
        s("true_label = 0 and predicted_label = 0").alias("tn"), erde(frame, 5).alias("erde_5"), erde(frame, 50).alias("erde_50"), speed().alias("speed"), *[at(k).alias(f"p_at_{k}") for k in (1, 5, 10)],
    )
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return agg.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": f1_of(tp, fp, fn)}).withColumn("f_latency", F.col("f1") * F.col("speed"))


def latency_weighted_f1(frame: DataFrame, p: float = 0.0078) -> DataFrame:
    penalty = -1.0 + 2.0 / (1.0 + F.exp(-p * (F.col("posts_seen") - 1)))
    s = lambda c: F.sum(F.expr(f"if({c}, 1, 0)"))
    wide = frame.withColumn("_p", F.when(F.expr(TP), penalty))
    agg = wide.agg(s(TP).alias("tp"), s("true_label = 0 and predicted_label = 1").alias("fp"), s("true_label = 1 and predicted_label = 0").alias("fn"), F.expr("percentile(_p, 0.5D)").alias("_m"), F.expr(f"percentile(if({TP}, posts_seen, null), 0.5D)").alias("median_latency"))
    out = agg.select(f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), F.coalesce(1 - F.col("_m"), F.lit(0.0)).alias("speed"), "median_latency")
    return out.withColumn("latency_weighted_f1", F.col("f1") * F.col("speed"))
