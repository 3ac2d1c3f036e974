"""Registered queries: metric rollups and the two streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.functions.prompts import METRICS
from stepwright.functions.text import words
from stepwright.operators import metrics, partials
from stepwright.plans import inputs
from stepwright.plans import oracle_inputs as sql
from stepwright.sources.tables import table_stream
from stepwright.sources.workspace import new_path
from stepwright.streaming import intervals, rollup, verdicts


def settled(mean: Column, points: Column) -> Column:
    """A mean to six places, by way of its sum: the order of adding must not decide a tie."""
    return F.round(F.round(mean * points, 4) / points, 6)


def metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = metrics.metric_rollup(inputs.metric_points(spark, sf))
    return rolled.select("mode", "interval", "metric", settled(F.col("value"), F.col("points")).alias("value"), "points")


def metric_increments(spark: SparkSession, sf: str) -> DataFrame:
    """The rollup from stored partials: half of the log, then all of it, of which only the new steps are added."""
    table = new_path(spark, "partials")
    points = inputs.metric_points(spark, sf).select(
        "mode", "step", "metric", "value", F.pmod(F.xxhash64("step"), F.lit(4)).alias("shard"))
    middle = points.agg(F.floor(F.avg("step"))).first()[0]
    for part in (points.where(F.col("step") <= middle), points, points):
        partials.extend(part, table)
    return partials.rollup(partials.read_partials(spark, table)).select(
        "mode", "interval", "metric", settled(F.col("value"), F.col("points")).alias("value"), "points", "low", "high")


def tokens_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as training batches of 32; one language is evaluation only."""
    batches = inputs.documents(spark, sf).select(
        F.floor(F.col("doc_id") / 32).alias("step"), F.size(words(F.col("text"))).alias("tokens"),
        F.when(F.col("lang") == "de", "eval").otherwise("train").alias("mode"))
    return metrics.tokens_seen(batches)


def _reply_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Judge replies of a stream of documents, each sent twice."""
    # parting documents by item ships each text once; their eight verdicts then meet in place
    docs = table_stream(spark, sf, "documents").repartition("doc_id")
    replies = inputs.judge_replies(inputs.generation_items_of(docs))
    number = F.col("item_id") * len(METRICS) + F.col("k")
    # the repeat says something else and comes later, so it must not win
    sent = F.explode(F.array(
        F.struct(number.alias("reply_no"), F.col("raw").alias("raw")),
        F.struct((number + (1 << 40)).alias("reply_no"), F.lit("<answer>late</answer>").alias("raw"))))
    return replies.select("item_id", "metric", sent.alias("s")).select("item_id", "metric", "s.*")


def incremental_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts taken up from a stream, then a restart that finds nothing new."""
    target, checkpoint = new_path(spark, "verdicts"), new_path(spark, "verdicts-progress")
    for _ in range(2):
        verdicts.ingest_verdicts(_reply_stream(spark, sf), target, checkpoint)
    return verdicts.read_verdicts(spark, target)


def compacted_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The same table rewritten with one verdict a pair, and the batches that the rewrite holds deleted."""
    target, checkpoint = new_path(spark, "verdicts"), new_path(spark, "verdicts-progress")
    verdicts.ingest_verdicts(_reply_stream(spark, sf), target, checkpoint)
    verdicts.compact_verdicts(spark, target)
    verdicts.remove_compacted(spark, target)
    return verdicts.read_verdicts(spark, target)


def streaming_metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    target, checkpoint = new_path(spark, "rollup"), new_path(spark, "rollup-progress")
    points = table_stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), "value")
    rollup.stream_rollup(points, target, checkpoint)
    return rollup.read_rollup(spark, target).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "metric",
        settled(F.col("value"), F.col("points")).alias("value"), "points")


def streaming_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The means per logging interval from a stream of two files of points, cut in the middle of intervals.

    The query ends and starts again between the files; the second also has points of
    steps long gone by.
    """
    source, target, checkpoint = (new_path(spark, n) for n in ("points", "intervals", "intervals-progress"))
    points = inputs.metric_points(spark, sf).select("mode", "step", "metric", "value")
    late = F.col("step") % 100 == 7
    middle = points.agg(F.floor(F.avg("step"))).first()[0]
    for part in ((F.col("step") <= middle) & ~late, (F.col("step") > middle) | late):
        points.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(points.schema).parquet(source)
        intervals.stream_intervals(stream, target, checkpoint).awaitTermination()
    return intervals.read_intervals(spark, target).select(
        "mode", "interval", "metric", settled(F.col("value"), F.col("points")).alias("value"), "points")


QUERIES = {f.__name__: f for f in (
    metric_rollup, metric_increments, tokens_seen, incremental_verdicts, compacted_verdicts, streaming_metric_rollup, streaming_intervals)}

ORACLES = {
    "metric_rollup": f"""WITH {sql.POINTS}
        SELECT mode, step // 8 AS interval, CASE WHEN mode = 'eval' THEN 'eval_' || metric ELSE metric END AS metric,
          round(round(avg(value) * count(value), 4) / count(value), 6) AS value, count(value) AS points FROM points GROUP BY ALL""",
    "metric_increments": f"""WITH {sql.POINTS}
        SELECT mode, step // 8 AS interval, CASE WHEN mode = 'eval' THEN 'eval_' || metric ELSE metric END AS metric,
          round(round(avg(value) * count(value), 4) / count(value), 6) AS value, count(value) AS points,
          min(value) AS low, max(value) AS high FROM points GROUP BY ALL""",
    "streaming_intervals": f"""WITH {sql.POINTS}
        SELECT mode, step // 8 AS interval, CASE WHEN mode = 'eval' THEN 'eval_' || metric ELSE metric END AS metric,
          round(round(avg(value) * count(value), 4) / count(value), 6) AS value, count(value) AS points FROM points GROUP BY ALL""",
    "tokens_seen": f"""WITH t AS (
          SELECT doc_id // 32 AS step, sum(len({sql.words('text')}))::BIGINT AS tokens FROM documents
          WHERE lang <> 'de' GROUP BY ALL)
        SELECT step, tokens, sum(tokens) OVER (ORDER BY step)::BIGINT AS tokens_seen FROM t""",
    "incremental_verdicts": f"""WITH {sql.VERDICTS}
        SELECT item_id, metric, answer, explanation, extract_pref FROM verdicts""",
    "compacted_verdicts": f"""WITH {sql.VERDICTS}
        SELECT item_id, metric, answer, explanation, extract_pref FROM verdicts""",
    "streaming_metric_rollup": """
        SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS metric,
          round(round(avg(value) * count(value), 4) / count(value), 6) AS value, count(value) AS points FROM events GROUP BY ALL""",
}
