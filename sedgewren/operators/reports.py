"""Smaller report operators: reindexing, coverage, pivots of results, frozen operating points."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import pseudonym
from ..session import stored
from . import metrics, stats
from .ordered import exact_quantiles
from .splits import unit_hash


def counted(frame: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A stage's result as a written table, and its row count from the files' footers, for a log line."""
    table = stored(frame)
    rows = table.count()
    logging.getLogger("sedgewren").info("%s: %d rows", name, rows)
    return table, rows


def reindex(frame: DataFrame, keys: DataFrame, key: str, fill: dict[str, float | int | str]) -> DataFrame:
    """A row for each key of a list, with missing values filled."""
    return keys.select(key).join(frame, key, "left").fillna(fill)


def by_pseudonym(raw: DataFrame, author: str, cohort: DataFrame, column: str = "author_hash") -> DataFrame:
    """The rows whose author's pseudonym is in the cohort. The name leaves with its column; only the pseudonym is kept."""
    hashed = raw.withColumn(column, pseudonym(F.col(author))).drop(author)
    return hashed.join(cohort.select(column).distinct(), column, "left_semi")


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    """Counts of each value, null among them."""
    return frame.groupBy(column).agg(F.count("*").alias("n"))


def coverage(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The share of rows that have each column."""
    return frame.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(f"covered_{c}") for c in columns])


def overview(frame: DataFrame, community: str, text: str) -> DataFrame:
    return frame.groupBy(community).agg(F.count("*").alias("n"), F.avg(F.length(text)).alias("mean_length"), F.expr(f"percentile(length({text}), 0.5D)").alias("median_length"))


def axis_cut(frame: DataFrame, column: str, share: float = 0.99) -> DataFrame:
    return exact_quantiles(frame, column, [share]).withColumnRenamed("q0", "cut")


def with_group_max(frame: DataFrame, group: str, column: str, name: str) -> DataFrame:
    """A group's greatest value on each of its rows: an aggregate and a join, so a large group needs no window."""
    return frame.join(frame.groupBy(group).agg(F.max(column).alias(name)), group, "left")


def pivot_results(frame: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Mean of a value by row and (given) column."""
    return frame.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def frozen_point(frame: DataFrame, threshold: float, part: str, y: str = "y", score: str = "score") -> DataFrame:
    """Of each part at one given threshold: F1 and recall where both classes occur (else null), and the share called positive."""
    pred = (F.col(score) >= threshold).cast("long")
    c = metrics.counts(F.col(y), pred)
    agg = frame.groupBy(part).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in c.items()])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    both = (tp + fn > 0) & (fp + tn > 0)
    return agg.select(part, "n", F.when(both, metrics.f1_of(tp, fp, fn)).alias("f1"), F.when(both, metrics.ratio(tp, tp + fn)).alias("recall"), ((tp + fp) / F.col("n")).alias("positive_rate"))


def stratified_sample(frame: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in all (a sampling operator), each class by its share, rounded; drawn by hash."""
    total = frame.agg(F.count("*").alias("_all"))
    sizes = frame.groupBy(label).agg(F.count("*").alias("_n")).join(F.broadcast(total))  # one row
    quota = sizes.select(F.col(label).alias("_l"), F.round(F.lit(float(n)) * F.col("_n") / F.col("_all")).cast("long").alias("_q"))
    # A row's rank is that within its class and hash bucket, after the sizes of the buckets before: no window holds a class.
    wide = frame.withColumn("_u", unit_hash(F.col(key), seed)).withColumn("_b", F.floor(F.col("_u") * 4096).cast("int"))
    buckets = wide.groupBy(label, "_b").agg(F.count("*").alias("_m"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(F.col(label).alias("_l2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o"))
    placed = wide.join(offsets, wide[label].eqNullSafe(F.col("_l2")) & (F.col("_b") == F.col("_b2")))
    ranked = placed.withColumn("_r", F.col("_o") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_u", key))).drop("_u", "_b", "_l2", "_b2", "_o")
    return ranked.join(quota, ranked[label].eqNullSafe(F.col("_l"))).where("_r <= _q").drop("_r", "_l", "_q")


def assemble(keys: DataFrame, parts: Sequence[DataFrame], key: str, fill: float = 0.0) -> DataFrame:
    """A user's features from several tables, joined on one key (one shuffle of each) with gaps filled."""
    out = keys.select(key).distinct()
    for part in parts:
        out = out.join(part, key, "left")
    return out.fillna(fill)


def full_report(frame: DataFrame, key: str, y: str = "y", score: str = "score", threshold: float | None = None, draws: int = 500, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row: metrics at a threshold (that of greatest F1 if none is given), areas, calibration error, and percentile intervals of F1 and both areas."""
    if threshold is None:
        best = metrics.best_threshold(frame, y, score).first()
        threshold = 0.5 if best is None or best["threshold"] is None else float(best["threshold"])
    labels = frame.select(key, F.col(y).cast("long").alias("_pos"), (1 - F.col(y).cast("long")).alias("_neg"), F.col(score).alias("score"))
    drawn, by = stored(stats.drawn_sums(labels, key, ["_pos", "_neg"], draws, seed, "score")), ("draw",)
    over = F.col("score") >= threshold
    part = lambda name, which: F.sum(F.when(which, F.col(name)).otherwise(0))
    f1 = drawn.groupBy("draw").agg(metrics.f1_of(part("_pos", over), part("_neg", over), part("_pos", ~over)).alias("f1"))
    each = f1.join(metrics.auroc(drawn, y, "score", by), "draw").join(metrics.auprc(drawn, y, "score", by), "draw")
    limits = each.agg(*[F.expr(f"percentile({m}, {p}D)").alias(f"{m}_ci_{side}") for m in ("f1", "auroc", "auprc") for side, p in (("lo", alpha / 2), ("hi", 1 - alpha / 2))])
    out = metrics.basic_metrics(frame, y, score, threshold).withColumn("threshold", F.lit(threshold))
    for part in (metrics.auroc(frame, y, score), metrics.auprc(frame, y, score), metrics.calibration_error(frame, y, score), limits):
        out = out.join(F.broadcast(part))  # one row each
    return out


def read_reports(spark: SparkSession, path: str, separator: str = "__") -> DataFrame:
    """Rows of metric files named model__target__metrics.json (files, or folders that Spark wrote), with model and target from the name."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)metrics\.json", 1)
    kind = "map<string,string>"
    metrics_of = F.coalesce(F.from_json("value", kind), F.get(F.from_json("value", f"array<{kind}>"), 0))
    rows = spark.read.text(path, wholetext=True).select(F.split(name, separator).alias("p"), metrics_of.alias("m"))
    long = rows.select(F.get("p", 0).alias("model"), F.get("p", 1).alias("target"), F.explode("m").alias("metric", "value"))
    return long.withColumn("value", F.expr("try_cast(value AS double)"))
