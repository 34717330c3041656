"""Places and running sums within groups, without one task per group.

Rows are dealt into ranges of about ``AIM`` rows by group and order (a row number breaks ties, so equal rows and a
group that holds most rows are split too), numbered inside each range, and moved by the totals of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.scratch import Scratch

#: Rows of a range; the number of ranges grows with the table.
AIM = 200_000


def numbered(rows: DataFrame, group: str, keys: list[str], value: str | None = None, aim: int = AIM, scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with ``idx`` (place in the group from 0), ``n`` (rows of the group), and ``upto`` (sum of ``value`` so far, own included).

    Nulls come first in each key, ``group`` isn't null. Rows that are equal in all keys take places in any order. Columns ``tie_``,
    ``part_``, ``own_``, ``before_``, ``idx``, ``n`` and ``upto`` must be free.
    """
    scratch = scratch or Scratch(rows.sparkSession, "ranges")
    kept = scratch.kept(rows)
    ranges = max(1, -(-kept.count() // aim))
    dealt = kept.withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(ranges, group, *keys, "tie_")
    dealt = scratch.kept(dealt.withColumn("part_", F.spark_partition_id()))
    own = Window.partitionBy(group, "part_").orderBy(*keys, "tie_")
    placed = dealt.withColumn("idx", F.row_number().over(own).cast("long") - 1)
    each = dealt.groupBy(group, "part_").agg(F.count("*").alias("own_"), (F.sum(value) if value else F.lit(0)).cast("long").alias("sum_"))
    # a row for each range of a group: few, however many rows the group has
    whole = Window.partitionBy(group)
    before = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(
        group, "part_", F.coalesce(F.sum("own_").over(before), F.lit(0)).alias("before_"), F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("under_"), F.sum("own_").over(whole).alias("n")
    )
    if value:
        placed = placed.withColumn("upto", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(starts, [group, "part_"]).withColumn("idx", F.col("idx") + F.col("before_"))
    if value:
        placed = placed.withColumn("upto", F.col("upto") + F.col("under_"))
    return placed.drop("tie_", "part_", "own_", "before_", "under_")
