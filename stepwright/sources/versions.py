"""Sinks whose reruns never leave a reader without a result.

A table is a folder of versions. A rerun writes its rows to a new one and then
publishes it by a record; readers follow the newest complete record. A run that
fails before its record is complete leaves the earlier result as it was, and what
it wrote is cleared later by `remove_superseded`.

  rows-*/                  the versions, each written once and never changed
  _published/record-*/     one line of JSON each: the version it publishes

One run publishes to a table at a time; any number may read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepwright.sources import json_files


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in ascending order."""
    path, system = _path(spark, pattern)
    return sorted(f.getPath().toString() for f in system.globStatus(path) or [])


def _records(spark: SparkSession, table: str) -> list[str]:
    """Names of the complete records, oldest first; Spark marks a record once it is all written."""
    return [p.split("/")[-2] for p in _names(spark, f"{table}/_published/record-*/_SUCCESS")]


def _version_of(spark: SparkSession, table: str, record: str) -> str:
    return json.loads(spark.read.text(f"{table}/_published/{record}").first()[0])["rows"]


def publish(df: DataFrame, table: str, write: Callable[[DataFrame, str], None]) -> int:
    """Write `df` as a new version by `write(df, folder)` and make it the one to read; its number, from 1.

    `df` may have been read from the version before: that stays as it is.
    """
    spark, rows = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    write(df, f"{table}/{rows}")
    records = _records(spark, table)
    number = int(records[-1].split("-")[1]) + 1 if records else 1
    spark.createDataFrame([(json.dumps({"rows": rows}),)], "value string").coalesce(1).write.text(
        f"{table}/_published/record-{number:08d}-{uuid.uuid4().hex}")
    return number


def publish_json_lines(df: DataFrame, table: str, numbers: tuple[str, ...] = ()) -> int:
    return publish(df, table, lambda rows, folder: json_files.write_json_lines(rows, folder, numbers))


def publish_by_file(df: DataFrame, table: str, *by: str) -> int:
    return publish(df, table, lambda rows, folder: json_files.write_by_file(rows, folder, *by))


def published(spark: SparkSession, table: str) -> str:
    """The folder of the newest published version."""
    records = _records(spark, table)
    if not records:
        raise FileNotFoundError(f"nothing was published to {table}")
    return f"{table}/{_version_of(spark, table, records[-1])}"


def remove_superseded(spark: SparkSession, table: str, keep: int = 1) -> int:
    """Delete all but the newest `keep` published versions, and what failed runs left; the number of folders.

    To be called while nothing else publishes, and nothing reads what goes.
    """
    if keep < 1:
        raise ValueError("the newest version stays")
    kept = _records(spark, table)[-keep:]
    if not kept:
        return 0
    stays = set(kept) | {_version_of(spark, table, r) for r in kept}
    # records go first, so that none ever names a version that is gone
    old = [p for pattern in ("_published/record-*", "rows-*") for p in _names(spark, f"{table}/{pattern}")
           if p.split("/")[-1] not in stays]
    for name in old:
        path, system = _path(spark, name)
        system.delete(path, True)
    return len(old)
