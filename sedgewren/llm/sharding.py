"""Contiguous shards of near-equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .order import numbered


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row, and the columns ``carry``, whose names must be others.

    Rows stand in the order of ids (null first), then of size and checksum. A row whose bytes begin at b of B in all
    and whose middle lies in the s-th of ``shards`` equal parts of B goes to shard s, so shards are contiguous, and each
    is within the size of its two border rows of B / shards; a shard may be empty if a row is larger than that. Slots count from 0
    in each shard. size is the text's UTF-8 bytes plus 1; a null text has none, and the checksum of the empty one.
    Repeated rows are rows of their own. An empty table gives an empty result. Texts are read once, to
    measure them; only ids and two numbers (and ``carry``) are shuffled.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    if clash := {c.lower() for c in carry or ()} & set(names):
        raise ValueError(f"columns to carry have names of the result: {sorted(clash)}")
    number, total, before, whole, first = fresh([*names, *(carry or ())], 5)
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = scratch.put(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), *(carry or ())))
    placed = numbered(sized, scratch, ["doc_id", "size", "text_crc32"], number, total, size="size", before=before, whole=whole)
    middle = (F.col(before) * 2 + F.col("size")) * shards
    cut = scratch.put(placed.withColumn("shard", ((middle - middle % (F.col(whole) * 2)) / (F.col(whole) * 2)).cast("int")).drop(total, before, whole))
    begins = cut.groupBy("shard").agg(F.min(number).alias(first))  # a row for each shard
    out = cut.join(F.broadcast(begins), "shard").withColumn("slot", F.col(number) - F.col(first))
    return out.select(*names, *(carry or ()))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows with all their columns to ``path``/shard=N, each folder's files in the order of slots, beside columns size, text_crc32 and slot.

    A column of the caller's named size, text_crc32, shard or slot raises. Each shard is dealt to as many
    files as its part of the ranges gives; none is gathered in one task. Null texts are kept as null.
    """
    carry = [c for c in docs.columns if c.lower() != id_col.lower()]
    placed = assign(docs, shards, id_col, text_col, carry)
    if id_col != "doc_id":
        placed = placed.withColumnRenamed("doc_id", id_col)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
