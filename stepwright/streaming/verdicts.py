"""Resumable verdict ingestion.

Batches append to a table, which now and then is rewritten with one verdict for
each pair. The rewritten rows lie in a version folder of their own; a small record,
written when they are complete, says which batches they hold. Readers follow the
newest record, so a rewrite that fails leaves what there was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.operators.judge import first_verdicts, parse_verdicts

VERDICT = ("item_id bigint, metric string, reply_no bigint, answer string, explanation string, "
           "extract_pref string")


def ingest_verdicts(replies: DataFrame, table: str, checkpoint: str, within: str | None = None) -> None:
    """Append the verdicts of a reply stream (`reply_no`, `raw`) to a verdict table.

    With `within`, a delay, replies have their time in `ts`, and one that is sent again
    as it was, no later than that, is dropped by keys kept in the stream's state.

    A batch writes what it got and reads nothing, so its cost doesn't grow with
    the table. It owns one folder and overwrites it, so a batch run again leaves
    the same rows. The folder carries the query's id, which lives in its
    checkpoint: a query begun anew leaves the rows of earlier ones alone.
    """
    columns = [c.split()[0] for c in VERDICT.split(", ")]
    # a table to read from, even if no reply ever comes
    replies.sparkSession.createDataFrame([], VERDICT).write.mode("ignore").parquet(f"{table}/run=none/batch_id=-1")

    if within is not None:
        same = F.xxhash64("raw").alias("_same")
        replies = replies.select("*", same).withWatermark("ts", within).dropDuplicatesWithinWatermark(
            ["item_id", "metric", "reply_no", "_same"]).drop("_same")

    def add(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        parse_verdicts(batch).select(*columns).write.mode("overwrite").parquet(
            f"{table}/run={run}/batch_id={batch_id}")

    query = (replies.writeStream.foreachBatch(add)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def _exists(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern stands for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [f.getPath().toString() for f in found]


def _newest(spark: SparkSession, table: str) -> tuple[int, str | None, dict[str, int]]:
    """Number and folder of the newest complete rewrite, and the last batch of each run that it holds."""
    records = sorted(p.split("/")[-2] for p in _exists(spark, f"{table}/_compacted/record-*/_SUCCESS"))
    if not records:
        return 0, None, {}
    held = json.loads(spark.read.text(f"{table}/_compacted/{records[-1]}").first()[0])
    return int(records[-1].split("-")[1]), f"{table}/_compacted/{held['rows']}", held["batches"]


def _commit(spark: SparkSession, table: str, number: int, rows: str, batches: dict[str, int]) -> None:
    """Spark marks the record as complete once it is written, which makes the rewrite the one to read."""
    record = json.dumps({"rows": rows, "batches": batches})
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.text(
        f"{table}/_compacted/record-{number:08d}-{uuid.uuid4().hex}")


def _held(batches: dict[str, int]) -> Column:
    """Whether a row's batch is among those a rewrite holds; on folder names only."""
    held = F.lit(False)
    for run, last in batches.items():
        held = held | (F.col("run") == run) & (F.col("batch_id") <= last)
    return held


def _appended(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(VERDICT + ", run string, batch_id bigint").parquet(table)


def _merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """One verdict for each pair; rows of `old`, of which there is one a pair, are sorted only where `new` has the pair."""
    if old is None:
        return first_verdicts(new)
    pairs = new.select(F.col("item_id").alias("_i"), F.col("metric").alias("_m")).distinct()
    met = F.col("item_id").eqNullSafe(F.col("_i")) & F.col("metric").eqNullSafe(F.col("_m"))
    return old.join(pairs, met, "left_anti").unionByName(
        first_verdicts(old.join(pairs, met, "left_semi").unionByName(new)))


def compact_verdicts(spark: SparkSession, table: str) -> int:
    """Rewrite what complete batches have appended as one verdict a pair; the number of the rewrite."""
    number, folder, batches = _newest(spark, table)
    upto = dict(batches)
    for path in _exists(spark, f"{table}/run=*/batch_id=*/_SUCCESS"):
        run, batch = (part.split("=")[1] for part in path.split("/")[-3:-1])
        upto[run] = max(int(batch), upto.get(run, -1))
    new = _appended(spark, table).where(_held(upto) & ~_held(batches)).drop("run", "batch_id")
    old = spark.read.schema(VERDICT).parquet(folder) if folder else None
    rows = f"rows-{uuid.uuid4().hex}"
    _merged(old, new).write.parquet(f"{table}/_compacted/{rows}")
    _commit(spark, table, number + 1, rows, upto)
    return number + 1


def remove_compacted(spark: SparkSession, table: str) -> int:
    """Delete batches that the newest rewrite holds, and everything of older or failed ones; the number of folders.

    To be called while nothing else reads or rewrites the table.
    """
    _, folder, batches = _newest(spark, table)
    if folder is None:
        return 0
    newest = sorted(p.split("/")[-2] for p in _exists(spark, f"{table}/_compacted/record-*/_SUCCESS"))[-1]
    old = [p for p in _exists(spark, f"{table}/_compacted/*")
           if p.split("/")[-1] not in (newest, folder.split("/")[-1])]
    for path in _exists(spark, f"{table}/run=*/batch_id=*"):
        run, batch = (part.split("=")[1] for part in path.split("/")[-2:])
        if 0 <= int(batch) <= batches.get(run, -1):
            old.append(path)
    for name in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(old)


def read_verdicts(spark: SparkSession, table: str) -> DataFrame:
    """One verdict for each (item, metric), the reply of smallest number, whichever batch or query brought it.

    What the newest rewrite holds is read as it is, but for pairs that came again since.
    """
    _, folder, batches = _newest(spark, table)
    new = _appended(spark, table).where(~_held(batches)).drop("run", "batch_id")
    old = spark.read.schema(VERDICT).parquet(folder) if folder else None
    return _merged(old, new).drop("reply_no")
