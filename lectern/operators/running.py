"""Running totals whose groups may be as large as the table.

A window over a whole group would sort all of it in one task. Here an integer order key is cut into
ranges of `width`: sums by range are partial in each task, a window runs over the few ranges of a
group, and another over the rows of one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def total_before(rows: DataFrame, group: str, order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the sum of value over those of the same group with a smaller order key, which is an integer, unique in its group."""
    rows = rows.withColumn("_range", F.floor(F.col(order) / width))
    sums = rows.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(sums, [group, "_range"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_before", "_within")
