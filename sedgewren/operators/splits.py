"""Splits and folds that do not depend on partitions: by hash, by group, by class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from md5 of seed and key."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def stratified_split(frame: DataFrame, key: str, label: str | None, test: float = 0.2, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split (train, val, test) of exact shares within each class.

    A row's place is its rank by hash within its class and hash bucket, plus the sizes of the buckets before:
    no window holds a whole class.
    """
    by = [F.lit(0).alias("_c")] if label is None else [F.col(label).alias("_c")]
    wide = frame.withColumns({"_u": unit_hash(F.col(key), seed), "_c": by[0]}).withColumn("_b", F.floor(F.col("_u") * 256).cast("int"))
    sizes = wide.groupBy("_c", "_b").agg(F.count("*").alias("_m"))
    own = Window.partitionBy("_c")
    offsets = sizes.select(F.col("_c").alias("_c2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_m").over(own.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_m").over(own).alias("_n"))
    ranked = wide.join(offsets, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_b") == F.col("_b2")))
    place = F.col("_o") + F.row_number().over(Window.partitionBy("_c", "_b").orderBy("_u", key))
    n_test, n_val = F.round(F.col("_n") * test), F.round(F.col("_n") * val)
    name = F.when(place <= n_test, "test").when(place <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", name).drop("_u", "_b", "_c", "_c2", "_b2", "_o", "_n")


def group_split(frame: DataFrame, group: str, shares: Sequence[tuple[str, float]] = (("test", 0.2), ("val", 0.1), ("train", 0.7)), seed: int = 42) -> DataFrame:
    """Adds split by a hash of the group, so that no group is on two sides; no shuffle at all."""
    u, out, at = unit_hash(F.col(group), seed), None, 0.0
    for name, share in shares[:-1]:
        at += share
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return frame.withColumn("split", out.otherwise(shares[-1][0]) if out is not None else F.lit(shares[-1][0]))


def community_split(frame: DataFrame, community: str, held_out: Sequence[str]) -> DataFrame:
    """Adds split: test for the named communities, whatever their case."""
    return frame.withColumn("split", F.when(F.lower(community).isin([c.lower() for c in held_out]), "test").otherwise("train"))


def folds(frame: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return frame.withColumn("fold", F.floor(unit_hash(F.col(key), seed) * k).cast("long"))


def fixed_sample(frame: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by hash order (a sampling operator)."""
    return frame.withColumn("_u", unit_hash(F.col(key), seed)).orderBy("_u", key).limit(n).drop("_u")


def held_out(frame: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """The corpus without the sample."""
    return frame.join(sample.select(key), key, "left_anti")


def feature_masks(names: Sequence[str], groups: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Leave-one-group-out and only-group column lists for ablations."""
    out = {}
    for group, prefixes in groups.items():
        own = [n for n in names if n.startswith(tuple(prefixes))]
        out[f"without_{group}"] = [n for n in names if n not in own]
        out[f"only_{group}"] = own
    return out
