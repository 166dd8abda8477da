"""Places and running sums of a whole table in a given order, from the totals of its ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

#: Rows that a range holds on average at most; there are more ranges where the session asks for more.
RANGE_ROWS = 200_000


def numbered(table: DataFrame, scratch: Scratch, by: list[str], number: str, total: str, tree: str | None = None, size: str | None = None, before: str = "before", whole: str = "whole") -> DataFrame:
    """The table with each row's place (from 0) in the order of ``by`` and the count of rows, of the whole table or within each value of ``tree``.

    With ``size``: also the sum of sizes that precede the row, and the sum of all. ``table`` is one that ``scratch`` has
    written; ``tree`` holds no null. Nulls of ``by`` come first; ties fall by their place in the written table. Rows are
    dealt to ranges by all these, so that neither a hot key nor rows that repeat gather in one range. The totals of
    ranges, a row for each range and tree, are summed up in order; rows are ordered within their range only.
    """
    tie, part, held, n = fresh([*table.columns, number, total, before, whole], 4)
    group = [tree] if tree else []
    ranges = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // RANGE_ROWS))
    dealt = scratch.put(table.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(ranges, *group, *by, tie).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(*group, part).agg(F.count("*").alias(n), *([F.sum(size).alias(held)] if size else []))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*group)
    first, first_size = f"{n}_first", f"{held}_first"
    places = sums.select(
        *group, part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(first), F.sum(n).over(all_of).alias(total),
        *([F.coalesce(F.sum(held).over(earlier), F.lit(0)).alias(first_size), F.sum(held).over(all_of).alias(whole)] if size else []),
    )
    inside = Window.partitionBy(*group, part).orderBy(*by, tie)
    out = dealt.withColumn(number, F.row_number().over(inside).cast("long") - 1)
    if size:
        out = out.withColumn(before, F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(places, [*group, part]).withColumn(number, F.col(number) + F.col(first))
    if size:
        out = out.withColumn(before, F.col(before) + F.col(first_size))
    return out.drop(tie, part, first, first_size)
