"""Metric rollup over event time."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_means(points: DataFrame, width: str = "1 hour") -> DataFrame:
    """Mean per (metric, tumbling window); the same for a batch or a stream."""
    return points.groupBy(F.window("ts", width).alias("w"), "metric").agg(
        F.avg("value").alias("value"), F.count("value").alias("points")).select(
        F.col("w.start").alias("window_start"), "metric", "value", "points")


def run_of(spark: SparkSession, table: str, query_id: str) -> str:
    """The folder name of a query's run: a number that grows with each new query, and the query's id."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
    runs = sorted(n for n in names if re.match(r"run=\d+-", n))
    own = [n for n in runs if n.endswith(f"-{query_id}")]
    return own[0] if own else f"run={int(runs[-1][4:].split('-')[0]) + 1 if runs else 0:06d}-{query_id}"


def stream_rollup(points: DataFrame, table: str, checkpoint: str,
                  width: str = "1 hour", late: str = "1 hour") -> None:
    """Keep the windowed means of a stream in its own table; rows later than `late` are ignored.

    Every batch writes the windows it changed to its own folder, open ones
    included; `read_rollup` takes each window's newest row. A query begun anew,
    with a new checkpoint, reads all points again: its run replaces earlier ones.
    """
    rolled = windowed_means(points.withWatermark("ts", late), width)

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_of(spark, table, spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
        batch.write.mode("overwrite").parquet(f"{table}/{run}/batch_id={batch_id}")

    query = (rolled.writeStream.outputMode("update").foreachBatch(keep)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def read_rollup(spark: SparkSession, table: str) -> DataFrame:
    """Each window's newest row of the newest run."""
    rows = spark.read.parquet(table)
    newest = F.max_by(F.struct("value", "points"), F.col("batch_id")).alias("v")
    return rows.where(F.col("run") == rows.agg(F.max("run")).scalar()).groupBy("window_start", "metric").agg(
        newest).select("window_start", "metric", "v.*")
