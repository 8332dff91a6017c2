"""Running sums in an order over all rows of a group, without a task that holds the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markweave.session import cut_lineage


def running_before(df: DataFrame, groups: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over the rows of the group that come before a row in ``order``.

    Two levels: rows are range-partitioned by group and order and written, sums run within a partition, and each group's
    partitions add up before that (a row per group and partition it touches). ``order`` should name rows uniquely.
    """
    ranged = df.withColumn("_w", weight).repartitionByRange(*groups, *order).withColumn("_p", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # the partitions must not be drawn anew
    keys = [F.col(g) for g in groups] or [F.lit(1)]
    earlier = (Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*groups, "_p").agg(F.sum("_w").alias("_k"))
    starts = starts.select(*groups, "_p", F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(*earlier)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_w").over(Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    return ranged.withColumn("_inside", inside).join(starts, [*groups, "_p"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_w", "_p", "_inside", "_start")
