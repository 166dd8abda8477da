"""Threads: parent and child rows walked depth first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.events import working_folder


def depth_first(frame: DataFrame, thread: str, node: str, parent: str) -> DataFrame:
    """(thread, node, depth, position): the order of a depth-first walk, children by their id.

    Each node gets the path of ids from its root; sorting by path is the walk. Paths double in length: a node's
    piece of path is put behind the piece of the node where it begins, so a thread of depth n takes log2(n)
    rounds, each a join on (thread, node) written to the shared folder, until no piece is open. A piece with a
    node twice is a cycle's and goes.
    """
    spark, folder = frame.sparkSession, working_folder(frame.sparkSession)

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    base = put(frame.select(F.col(thread).alias("thread"), F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("parent")), "base")
    known = base.select(F.col("thread").alias("t"), F.col("node").alias("p")).distinct()
    on = (base.thread == known.t) & (base.parent == known.p)
    # up is the parent of a piece's first node where that is in the thread; a piece without it is a whole path.
    whole = base.join(known, on, "left_anti").select("thread", "node", F.lit(None).cast("long").alias("up"), F.array("node").alias("path"))
    rest = base.join(known, on, "left_semi").where("node is null or node <> parent").select("thread", "node", F.col("parent").alias("up"), F.array("node").alias("path"))
    pieces, number = put(whole.union(rest), "pieces-0"), 0
    done = pieces.where("up is null")
    while not pieces.where("up is not null").isEmpty():
        number += 1
        above = done.union(pieces.where("up is not null")).select(F.col("thread").alias("t"), F.col("node").alias("n"), F.col("up").alias("_up"), F.col("path").alias("before"))
        still = pieces.where("up is not null")
        longer = still.join(above, (still.thread == above.t) & (still.up == above.n)).select("thread", "node", F.col("_up").alias("up"), F.concat("before", "path").alias("path"))
        pieces = put(longer.where(F.size(F.array_distinct("path")) == F.size("path")), f"pieces-{number}")
        done = done.union(pieces.where("up is null"))
    return done.select(F.col("thread").alias(thread), F.col("node").alias(node), (F.size("path") - 1).cast("long").alias("depth"), F.row_number().over(Window.partitionBy("thread").orderBy("path")).cast("long").alias("position"))


def depth_first_sql(view: str, thread: str, node: str, parent: str) -> str:
    """The same walk as one recursive statement."""
    return f"""
WITH RECURSIVE walk(thread, node, depth, path) AS (
  SELECT r.{thread}, CAST(r.{node} AS BIGINT), CAST(0 AS BIGINT), lpad(CAST(r.{node} AS STRING), 12, '0')
  FROM {view} r WHERE NOT EXISTS (SELECT 1 FROM {view} p WHERE p.{thread} = r.{thread} AND p.{node} = r.{parent})
  UNION ALL
  SELECT c.{thread}, CAST(c.{node} AS BIGINT), w.depth + 1, concat(w.path, '/', lpad(CAST(c.{node} AS STRING), 12, '0'))
  FROM {view} c JOIN walk w ON c.{thread} = w.thread AND c.{parent} = w.node)
SELECT thread AS {thread}, node AS {node}, depth, CAST(row_number() OVER (PARTITION BY thread ORDER BY path) AS BIGINT) AS position FROM walk"""
