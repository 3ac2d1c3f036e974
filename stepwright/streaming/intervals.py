"""Metric means by logging interval, kept by a stream.

Points are combined within their task before they are shuffled. For each metric of
a mode the state holds the sums of the intervals that are open; a step of a later
interval closes them, and so does a timer once no point has come for a while. What
is closed leaves the state, so that it stays small however long a run is. A point
that comes after its interval was closed opens it anew: a result is the sum of all
that was closed for an interval, and of what was last seen open since.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stepwright.operators.metrics import LOGGING_STEPS, logged_name
from stepwright.streaming.rollup import run_of

PART = "mode string, metric string, interval bigint, total double, points bigint"
SUMS = f"{PART}, open boolean"

# the only state store that keeps this kind of state; a session's default is another
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def combined(points: DataFrame, every: int = LOGGING_STEPS) -> DataFrame:
    """Sums and counts per (mode, metric, interval) of stretches of rows; nothing is shuffled."""
    rows = points.select(
        F.col("mode").cast("string").alias("mode"), logged_name(F.col("mode"), F.col("metric")).alias("metric"),
        F.floor(F.col("step") / every).cast("bigint").alias("interval"), F.col("value").cast("double").alias("value"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = pa.Table.from_batches([b]).group_by(["mode", "metric", "interval"]).aggregate(
                [("value", "sum"), ("value", "count")])
            yield from sums.select(["mode", "metric", "interval", "value_sum", "value_count"]).rename_columns(
                ["mode", "metric", "interval", "total", "points"]).to_batches()

    return rows.mapInArrow(combine, PART)


def _open_intervals(idle_ms: int | None) -> StatefulProcessor:
    """The processor; its class is made here so that it is sent whole, as the process that
    declares its state need not be able to import this package."""
    class OpenIntervals(StatefulProcessor):
        """Of one metric of a mode: the sums of the intervals that are not closed yet."""

        def __init__(self, idle_ms: int | None):
            self.idle_ms = idle_ms

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.sums = handle.getMapState("sums", "interval bigint", "total double, points bigint")

        def _row(self, key, interval: int, total: float, points: int, is_open: bool) -> Row:
            return Row(mode=key[0], metric=key[1], interval=interval, total=total, points=points, open=is_open)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            held = {k[0]: (v[0], v[1]) for k, v in self.sums.iterator()}
            touched = set()
            for r in rows:
                total, points = held.get(r.interval, (0.0, 0))
                held[r.interval] = (total + (r.total or 0.0), points + r.points)
                touched.add(r.interval)
            newest = max(held)
            for interval, (total, points) in held.items():
                if interval < newest:
                    self.sums.removeKey((interval,))
                    yield self._row(key, interval, total, points, False)
                elif interval in touched:
                    self.sums.updateValue((interval,), (total, points))
                    yield self._row(key, interval, total, points, True)
            if self.idle_ms is not None:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            held = [(k[0], v[0], v[1]) for k, v in self.sums.iterator()]
            self.sums.clear()
            for interval, total, points in held:
                yield self._row(key, interval, total, points, False)

        def close(self) -> None:
            pass

    return OpenIntervals(idle_ms)


def stream_intervals(points: DataFrame, table: str, checkpoint: str, every: int = LOGGING_STEPS,
                     idle_ms: int | None = None, trigger: dict | None = None):
    """Start a query that keeps the interval means of a stream of points (mode, step, metric, value) in a table.

    By default it takes up what there is and ends. With `idle_ms` and a `trigger` that
    goes on, intervals are also closed once their metric has had no point for so long.
    A batch owns one folder and overwrites it, so a batch run again leaves the same
    rows; a query begun anew, with a new checkpoint, replaces earlier ones.
    """
    sums = combined(points, every).groupBy("mode", "metric").transformWithState(
        _open_intervals(idle_ms), SUMS, "Append", "None" if idle_ms is None else "ProcessingTime")

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_of(spark, table, spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
        batch.write.mode("overwrite").parquet(f"{table}/{run}/batch_id={batch_id}")

    writer = sums.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True}))
    # a query takes the session's settings with it when it starts
    conf, before = points.sparkSession.conf, points.sparkSession.conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


def read_intervals(spark: SparkSession, table: str) -> DataFrame:
    """(mode, interval, metric, value, points, open) of the newest run, as `metrics.metric_rollup` gives them."""
    rows = spark.read.parquet(table)
    rows = rows.where(F.col("run") == rows.agg(F.max("run")).scalar())
    closed, seen = ~F.col("open"), F.when(F.col("open"), F.col("batch_id"))
    found = rows.groupBy("mode", "interval", "metric").agg(
        F.sum(F.when(closed, F.col("total"))).alias("total"), F.sum(F.when(closed, F.col("points"))).alias("points"),
        F.max(F.when(closed, F.col("batch_id"))).alias("closed"),
        F.max(seen).alias("seen"), F.max_by("total", seen).alias("rest"), F.max_by("points", seen).alias("more"))
    still = F.col("seen").isNotNull() & (F.col("closed").isNull() | (F.col("seen") > F.col("closed")))
    summed = found.select("mode", "interval", "metric", still.alias("open"), *[
        (F.coalesce(done, F.lit(0)) + F.when(still, rest).otherwise(0)).alias(name) for name, done, rest in (
            ("total", F.col("total"), F.col("rest")), ("points", F.col("points"), F.col("more")))])
    return summed.select("mode", "interval", "metric", F.try_divide("total", "points").alias("value"), "points", "open")
