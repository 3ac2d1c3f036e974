"""Means per logging interval from a stream: restarts, late points, and a timer for the last."""

import math
import os
import random
import subprocess
import sys
import time
from pathlib import Path

from stepwright.operators import metrics
from stepwright.streaming import intervals

POINT = "mode string, step bigint, metric string, value double"


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, POINT).repartition(2).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(POINT).parquet(folder)


def read(spark, table):
    return {tuple(r)[:3]: (r.value, r.points) for r in intervals.read_intervals(spark, table).collect()}


def batch(spark, rows):
    return {(r.mode, r.interval, r.metric): (r.value, r.points)
            for r in metrics.metric_rollup(spark.createDataFrame(rows, POINT)).collect()}


def same(found, expected):
    assert found.keys() == expected.keys()
    for k, (value, points) in expected.items():
        assert found[k][1] == points
        assert found[k][0] is value is None or math.isclose(found[k][0], value) or math.isnan(found[k][0]) and math.isnan(value)


def test_stream_equals_the_batch_across_restarts(spark, tmp_path):
    folder, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    rng = random.Random(3)
    rows = [(rng.choice(["train", "eval"]), s, m, rng.random()) for s in range(60) for m in ("loss", "kl") for _ in range(3)]
    rows += [("train", 3, "odd", float("nan")), ("train", 4, "odd", 1.0), ("train", 9, "odd", None), (None, 9, "kl", 2.0)]
    so_far = []
    # cuts within intervals, nothing new, then steps that come again long after their interval was closed
    for part in ([r for r in rows if r[1] < 13], [], [r for r in rows if 13 <= r[1] < 37],
                 [r for r in rows if r[1] >= 37], [("train", 1, "loss", 5.0), ("train", 40, "loss", 7.0)]):
        if part:
            add_file(spark, folder, part)
            so_far += part
        intervals.stream_intervals(stream(spark, folder), table, progress).awaitTermination()
        same(read(spark, table), batch(spark, so_far))
    table_rows = intervals.read_intervals(spark, table).collect()
    assert any(r.open for r in table_rows) and not all(r.open for r in table_rows)
    # a query that lost its progress reads all again and replaces the rows
    intervals.stream_intervals(stream(spark, folder), table, str(tmp_path / "anew")).awaitTermination()
    same(read(spark, table), batch(spark, so_far))


def test_points_combine_before_they_are_shuffled(spark):
    rows = [("train", s, "loss", 1.0) for s in range(64) for _ in range(20)]
    found = intervals.combined(spark.createDataFrame(rows, POINT).coalesce(1))
    assert found.count() == 8 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_timer_closes_the_last_interval(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = [("train", s, "loss", float(s)) for s in range(12)]
    add_file(spark, folder, rows)
    query = intervals.stream_intervals(stream(spark, folder), table, str(tmp_path / "progress"), idle_ms=500,
                                       trigger={"processingTime": "200 milliseconds"})
    # batches go on as long as there may be timers, so there is no end to wait for
    try:
        until, done = time.time() + 60, False
        while time.time() < until and not done:
            time.sleep(1)
            if query.lastProgress and query.lastProgress["batchId"] > 0:
                found = intervals.read_intervals(spark, table).collect()
                done = len(found) == 2 and not any(r.open for r in found)
    finally:
        query.stop()
    assert not any(r.open for r in intervals.read_intervals(spark, table).collect())
    same(read(spark, table), batch(spark, rows))


PLAIN = """
import sys
repo, folder = sys.argv[1:]
sys.path.insert(0, repo)  # the driver's own path only
from pyspark.sql import SparkSession
from stepwright.streaming import intervals
spark = SparkSession.builder.master("local[2]").config(map={
    "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "2"}).getOrCreate()
provider = spark.conf.get(intervals.PROVIDER, None)
spark.createDataFrame([("train", s, "loss", 1.0) for s in range(20)], %r).write.parquet(f"{folder}/in")
points = spark.readStream.schema(%r).parquet(f"{folder}/in")
intervals.stream_intervals(points, f"{folder}/table", f"{folder}/progress").awaitTermination()
assert spark.conf.get(intervals.PROVIDER, None) == provider
rows = intervals.read_intervals(spark, f"{folder}/table").collect()
print("found", sorted((r.interval, r.points) for r in rows))
""" % (POINT, POINT)


def test_a_session_without_settings_or_paths_will_do(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", PLAIN, str(Path(__file__).parents[1]), str(tmp_path)], env=env,
                          cwd=tmp_path, text=True, capture_output=True, timeout=180)
    assert "found [(0, 8), (1, 8), (2, 4)]" in done.stdout, done.stderr[-2000:]
