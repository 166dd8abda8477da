"""Cumulative sums and ranks over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(frame: DataFrame, key: str, sums: dict[str, str], descending: bool = False, buckets: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``name``: the sum of column ``sums[name]`` over rows up to this one in the order of ``key``.

    ``frame`` has one row for each key and group ``by`` (counts by distinct score, say). Keys are cut into
    buckets of about as many rows each at approximate quantiles, so an outlier takes no room from others; totals
    of whole buckets are summed over a table of at most ``buckets`` rows a group, and rows are only ordered within
    their bucket, so no task holds all. There are 64 buckets, or as many as the session has shuffle partitions.
    """
    buckets = buckets or max(64, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = F.expr("array(" + ", ".join(f"{i / buckets}D" for i in range(1, buckets)) + ")")
    bounds = frame.groupBy(*by).agg(F.percentile_approx(key, shares, 20 * buckets).alias("_cuts"))
    # Without groups the bounds are one row; either way the plan's second use of ``frame`` reuses its shuffle.
    wide = frame.join(bounds, list(by)) if by else frame.join(F.broadcast(bounds))
    wide = wide.withColumn("_bucket", F.size(F.filter("_cuts", lambda cut: cut < F.col(key)))).drop("_cuts")
    totals = wide.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    order = F.desc if descending else F.asc
    before = Window.partitionBy(*by).orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    within = Window.partitionBy(*by, "_bucket").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    # Offsets have at most ``buckets`` rows for each group; AQE broadcasts them if they are small indeed.
    joined = wide.join(offsets, [*by, "_bucket"])
    return joined.withColumns({n: F.col(f"_o_{n}") + F.sum(c).over(within) for n, c in sums.items()}).drop("_bucket", *[f"_o_{n}" for n in sums])


def by_score(frame: DataFrame, y: Column, score: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Positive and negative rows of each distinct score: what curves and ranks need, after partial sums. A frame that has them
    (columns _pos and _neg) passes as it is."""
    if {"_pos", "_neg"} <= set(frame.columns):
        return frame.select(*by, score.cast("double").alias("score"), F.col("_pos").alias("pos"), F.col("_neg").alias("neg"))
    return frame.select(*by, score.cast("double").alias("score"), y.cast("long").alias("_y")).groupBy(*by, "score").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))


def exact_quantiles(frame: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with q0, q1, ...: quantiles with linear interpolation, from counts by distinct value and their running sums.

    Unlike a percentile aggregate no task holds all distinct values.
    """
    counted = frame.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    upto = running(counted, "_v", {"_upto": "_c"})
    total = counted.agg(F.sum("_c").alias("_n"))
    wide = upto.join(F.broadcast(total))  # one row
    out = []
    for i, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("_n") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(place), F.col("_v")))
        high = F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_v")))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(f"q{i}"))
    return wide.agg(*out)
