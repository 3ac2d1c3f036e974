"""Stored partial aggregates of metric points, extended by reruns with new steps only.

A table is a folder of increments, each written once:

  increment-*/      partial rows (mode, interval, metric, shard, total, points, low, high,
                    nan_points, last_step); it counts once Spark has marked it complete

A run that fails leaves an increment without the mark, which is never read: the next
run takes its steps up again. Points carry a `shard` (a process, a file) whose steps
are logged in ascending order, each as a whole: those up to a shard's last stored
step are known already. One run extends a table at a time; any number may read.

NaN values are counted apart: they are in no sum, minimum or maximum. Null values
aren't counted at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.operators.metrics import LOGGING_STEPS, logged_name

KEYS = ["mode", "interval", "metric"]
SCHEMA = ("mode string, interval bigint, metric string, shard string, total double, points bigint, low double, "
          "high double, nan_points bigint, last_step bigint")


def metric_partials(points: DataFrame, every: int = LOGGING_STEPS) -> DataFrame:
    """Points (mode, step, metric, value, shard) to a row per interval, metric and shard."""
    value = F.col("value").cast("double")
    number = F.when(~F.isnan(value), value)
    return points.groupBy(
        "mode", F.floor(F.col("step") / every).alias("interval"),
        logged_name(F.col("mode"), F.col("metric")).alias("metric"), F.col("shard").cast("string").alias("shard"),
    ).agg(F.sum(number).alias("total"), F.count(number).alias("points"), F.min(number).alias("low"),
          F.max(number).alias("high"), F.count_if(F.isnan(value)).alias("nan_points"),
          F.max(F.col("step").cast("bigint")).alias("last_step"))


def merged(partials: DataFrame, *by: str) -> DataFrame:
    """Partial rows added up, per (mode, interval, metric) and `by`; what is merged can be merged again."""
    return partials.groupBy(*KEYS, *by).agg(
        F.sum("total").alias("total"), F.sum("points").alias("points"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sum("nan_points").alias("nan_points"), F.max("last_step").alias("last_step"))


def rollup(partials: DataFrame) -> DataFrame:
    """(mode, interval, metric, value, points, low, high, nan_points); `value` is the mean of what is no NaN, or null."""
    return merged(partials).select(
        *KEYS, F.try_divide("total", "points").alias("value"), "points", "low", "high", "nan_points")


def _complete(spark: SparkSession, table: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/increment-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().getParent().toString() for f in found)


def read_partials(spark: SparkSession, table: str) -> DataFrame:
    """The rows of all complete increments; none where nothing was written."""
    increments = _complete(spark, table)
    return spark.read.schema(SCHEMA).parquet(*increments) if increments else spark.createDataFrame([], SCHEMA)


def new_points(points: DataFrame, partials: DataFrame) -> DataFrame:
    """Points of steps after the last one stored of their shard; a null shard is one of its own."""
    reached = partials.groupBy(F.col("shard").alias("_shard")).agg(F.max("last_step").alias("_reached"))
    return points.join(reached, F.col("shard").cast("string").eqNullSafe(F.col("_shard")), "left").where(
        F.col("_reached").isNull() | (F.col("step") > F.col("_reached"))).select(*points.columns)


def extend(points: DataFrame, table: str, every: int = LOGGING_STEPS) -> str:
    """Add what `points` have beyond the stored steps, as one increment; its folder.

    `points` may be all of a log or its newest part.
    """
    folder = f"{table}/increment-{uuid.uuid4().hex}"
    fresh = new_points(points, read_partials(points.sparkSession, table))
    metric_partials(fresh, every).write.parquet(folder)
    return folder


def compact(spark: SparkSession, table: str, target: str) -> None:
    """The increments of `table` merged into one of `target`, a new table; shards stay apart, so it can be extended."""
    partials = read_partials(spark, table)
    merged(partials, "shard").select(*partials.columns).write.parquet(f"{target}/increment-{uuid.uuid4().hex}")
