"""Model requests and replies as tables: no network calls are made here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepwright.sources.schemas import CHAT_REPLY


def ingest_replies(requests: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with their reply text as `raw`, '' where none can be read.

    `replies` has a JSON `body` per request: a chat reply or a completion. Of
    repeated replies one counts: a readable one first, then the smallest `reply_no`
    (a null one comes last), then the least hash.
    """
    first = F.get(F.from_json("body", CHAT_REPLY)["choices"], F.lit(0))
    number = F.col("reply_no").cast("bigint") if "reply_no" in replies.columns else F.xxhash64("body")
    texts = replies.select(*keys, number.alias("_order"),
                           F.coalesce(first["message"]["content"], first["text"]).alias("raw"))
    order = Window.partitionBy(*keys).orderBy(F.col("raw").isNull(), F.asc_nulls_last("_order"), F.xxhash64("raw"))
    # a limit on row_number would sort, and spill, all texts before they move as well
    one = texts.withColumn("_before", F.lag(F.lit(True)).over(order)).where("_before IS NULL").select(*keys, "raw")
    return requests.join(one, keys, "left").fillna("", ["raw"])


RUN_KEYS = ["pref_form", "task", "topic", "model"]


def write_runs(df: DataFrame, path: str) -> None:
    """Results laid out by run configuration.

    Rebalancing keeps the files per run few, and splits a run that is large.
    """
    df.hint("rebalance", *RUN_KEYS).write.mode("overwrite").partitionBy(*RUN_KEYS).parquet(path)


def read_run(spark: SparkSession, path: str, **run: str) -> DataFrame:
    """Results of the runs with these names; only their folders are read. None is an error."""
    found = spark.read.parquet(path)
    for key, value in run.items():
        found = found.where(F.col(key) == value)
    if found.isEmpty():
        raise FileNotFoundError(f"no results for {run} in {path}")
    return found
