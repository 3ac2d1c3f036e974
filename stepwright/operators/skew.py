"""Running totals that hold up when one key owns a large share of the rows.

Joins need nothing of the kind: they are plain shuffle joins, which adaptive
execution turns into broadcasts or splits at hot keys, whichever fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.sources.workspace import written


def running_sum(df: DataFrame, group: list[str], order: str, value: Column, out: str) -> DataFrame:
    """Running sum of `value` in `order`, unique per group, whatever the spacing of its values.

    Rows are range-partitioned by (group, order), so a large group spans many
    partitions. A window inside a partition gives the sum from the partition's
    first row of the group on; what came before is a sum over partitions, of
    which there is one row for each (group, partition) that meet.
    """
    keys = [F.col(c).asc() for c in [*group, order]]
    parts = written(
        df.withColumn("_value", value).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "parts")
    totals = parts.groupBy(*group, "_part").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_part").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        parts.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*group, "_part"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_part", "_value", "_inside", "_offset")
    )
