"""The shared folder, on a cluster of two executors that are processes of their own."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).parents[1])

CODE = """
import sys
from pyspark.sql import SparkSession
from stepwright.sources.workspace import new_path, written
folder, named = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map={
    "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "600m",
    "spark.checkpoint.dir": named, "spark.local.dir": f"{folder}/local",
    "spark.sql.warehouse.dir": f"{folder}/tables"}).getOrCreate()
rows = written(spark.range(100, numPartitions=4), "rows")
print("found", rows.count(), rows.agg({"id": "sum"}).first()[0], new_path(spark, "next"))
"""


def run(folder, named):
    env = os.environ | {"PYTHONPATH": REPO, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", CODE, str(folder), named], env=env, cwd=folder, text=True,
                          capture_output=True, timeout=180)
    found = [line.split() for line in done.stdout.splitlines() if line.startswith("found")]
    assert found, done.stderr[-2000:]
    return found[0]


def test_a_path_without_a_scheme_is_a_mounted_one(tmp_path):
    _, count, total, path = run(tmp_path, str(tmp_path / "kept"))
    assert (count, total) == ("100", "4950") and path.startswith(f"file:{tmp_path}/kept/next-")


def test_a_relative_path_is_the_drivers(tmp_path):
    assert run(tmp_path, "kept")[3].startswith(f"file:{tmp_path}/kept/next-")


def test_a_scheme_stays(tmp_path):
    assert run(tmp_path, f"file://{tmp_path}/kept")[3].startswith(f"file:{tmp_path}/kept/next-")
