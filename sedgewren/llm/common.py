"""Shared pieces: tables in the shared folder, and connected components by alternating stars."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without one (tests) gets a temporary folder; executors elsewhere would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sedgewren-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(taken: list[str], count: int) -> list[str]:
    """Column names that none of ``taken`` has, whatever its case."""
    used = {name.lower() for name in taken}
    stem = "_sw"
    while any(name.startswith(stem) for name in used):
        stem += "_"
    return [f"{stem}{i}" for i in range(count)]


_ROOTS: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean_up() -> None:
    """No result outlives the driver's process, so its scratch tables go with it (if the session still runs)."""
    for spark, root in _ROOTS:
        with contextlib.suppress(Exception):
            delete(spark, root)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors; deleted when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _ROOTS.append((spark, self.root))

    def put(self, frame: DataFrame) -> DataFrame:
        """Writes the frame and reads it back; ``drop`` takes what this returns."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        frame.write.parquet(path)
        read = self.spark.read.schema(frame.schema).parquet(path)
        read._sedgewren_path = path
        return read

    def drop(self, frame: DataFrame) -> None:
        """Deletes a table that no later plan reads."""
        delete(self.spark, frame._sedgewren_path)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has long columns u and v, in any order; nulls and loops are ignored. Returns (node, component)
    for each node of some edge, where component is the smallest id reachable. Each round takes two partial
    minimum aggregates and two joins that AQE may split, so no node with many links gathers in one task.
    """
    known = edges.where("u is not null and v is not null and u <> v")
    current = scratch.put(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:  # each round makes progress until the stars stand, so this ends
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.put(both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = scratch.put(large.groupBy("u").agg(F.min("v").alias("m")))
        # Each node points at its least neighbour, and its other smaller neighbours point there as well.
        moved = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.put(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (current, low, large, least):
            scratch.drop(old)
        current = small
        if tuple(state) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(state)
