"""Registered queries: judge evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.functions import prompts
from stepwright.operators import judge
from stepwright.plans import inputs
from stepwright.plans import oracle_inputs as sql
from stepwright.plans.jobs import judge_requests
from stepwright.sources import exchange, rubrics
from stepwright.sources.workspace import new_path

MODEL = "judge-model"


def _rubrics(spark: SparkSession) -> DataFrame:
    """The templates, written to and read from a folder as a user keeps them."""
    folder = new_path(spark, "rubrics")
    rubrics.write_rubrics(rubrics.default_rubrics(spark), folder)
    return rubrics.read_rubrics(spark, folder)


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.judge_replies(inputs.generation_items(spark, sf))


def _verdicts(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    return judge.parse_verdicts(_raw(spark, sf).select("item_id", "metric", *keep, "raw"))


def rubric_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Per metric: the scanned template, and how many items it is asked about."""
    asked = inputs.generation_items(spark, sf).where(F.col("replied")).select("item_id")
    pairs = judge.with_rubrics(asked, _rubrics(spark))
    return pairs.groupBy("metric", "template").agg(F.count(F.lit(1)).alias("items"))


def items_x_rubrics(spark: SparkSession, sf: str) -> DataFrame:
    items = inputs.generation_items(spark, sf).select("item_id", "topic")
    return judge.with_rubrics(items, rubrics.default_rubrics(spark)).select(
        "item_id", "topic", "metric", "template")


def render_judge_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of all eight metrics for every item, as asked of a fresh run.

    The preference an `acknow` verdict quoted is known for some items only.
    """
    items = inputs.generation_items(spark, sf)
    quoted = inputs.finished_verdicts(items).where(F.col("metric") == "acknow").select(
        "item_id", F.col("extract_pref").alias("restatement"))
    texts = items.where(F.col("replied")).select(
        "item_id", "preference", "question", "response_to_q").join(quoted, "item_id", "left")
    pairs = judge.with_rubrics(texts, rubrics.default_rubrics(spark))
    return pairs.where((F.col("metric") != "hallucinate") | F.col("restatement").isNotNull()).select(
        "item_id", "metric", prompts.fill_rubric(
            F.col("template"), F.col("metric"), F.col("preference"), F.col("question"),
            F.col("response_to_q"), F.col("restatement")).alias("prompt"))


def pending_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    items = inputs.generation_items(spark, sf)
    return judge.pending(items, inputs.finished_verdicts(items))


def judge_request_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Request bodies of the pending pairs, written out and read back."""
    items = inputs.generation_items(spark, sf)
    requests = judge_requests(items, inputs.finished_verdicts(items))
    path = new_path(spark, "requests")
    requests.select("item_id", "metric", judge.request_payload(MODEL, F.col("prompt")).alias("body")).write.json(path)
    body = F.from_json("body", "model string, stream boolean, messages array<struct<role:string,content:string>>, "
                               "max_tokens int, temperature double")
    sent = spark.read.schema("item_id bigint, metric string, body string").json(path)
    return sent.select("item_id", "metric", body.alias("b")).select(
        "item_id", "metric", "b.model", F.col("b.stream").cast("int").alias("stream"), "b.max_tokens",
        "b.temperature", F.col("b.messages")[0]["content"].alias("system"),
        F.col("b.messages")[1]["content"].alias("prompt"))


def reply_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Reply text per request; vague replies come as an empty choice list, some do not come."""
    replies = _raw(spark, sf)
    choice = F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("raw").alias("content")).alias("message")))
    body = F.when(F.col("z") == 9, F.lit('{"choices": []}')).when(
        F.col("z") == 8, F.lit('{"error')).otherwise(F.to_json(F.struct(choice.alias("choices"))))
    came = replies.where(F.col("metric") != "thoughtful").select("item_id", "metric", body.alias("body"))
    requests = replies.select("item_id", "metric")
    return exchange.ingest_replies(requests, came, ["item_id", "metric"])


def parse_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf)


def hallucination_prompt_join(spark: SparkSession, sf: str) -> DataFrame:
    items = inputs.generation_items(spark, sf).select("item_id", "preference")
    return judge.restatement_pairs(items, _verdicts(spark, sf))


def _generated(topics: DataFrame) -> DataFrame:
    """What was generated for the topics: some items never were, others have no reply."""
    return topics.where(F.col("item_id") % 13 != 5)


def coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    by = ["pref_form", "task", "topic", "model"]
    topics = inputs.generation_items(spark, sf)
    return judge.coverage(topics, _generated(topics), by).withColumn("complete", F.col("complete").cast("int"))


def coverage_missing(spark: SparkSession, sf: str) -> DataFrame:
    """The items that the generations lack, or have no reply for."""
    topics = inputs.generation_items(spark, sf)
    return judge.missing_items(topics.select("item_id", "topic"), _generated(topics), ["item_id"])


def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with numbers, every third of them given again later with the next metric's text."""
    raw = _raw(spark, sf).withColumn("place", F.array_position(F.array(*[F.lit(m) for m in prompts.METRICS]), F.col("metric")))
    numbered = raw.withColumn("reply_no", (F.col("item_id") * 8 + F.col("place")).cast("bigint"))
    again = numbered.where((F.col("item_id") + F.col("place")) % 3 == 0).withColumns({
        "reply_no": F.col("reply_no") + 1_000_000_000,
        "raw": F.concat(F.lit("<answer>again</answer>"), F.col("raw"))})
    return judge.parse_verdicts(numbered.unionByName(again).select("item_id", "metric", "reply_no", "raw"))


def verdict_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """All fields of each item's verdicts, where many were given twice."""
    return judge.verdict_pivot(_repeated(spark, sf))


def all_metrics_present(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose verdicts are complete, and what the others miss."""
    seen = judge.done_masks(inputs.finished_verdicts(inputs.generation_items(spark, sf)))
    return seen.select("item_id", judge.metrics_open(F.col("done")).alias("missing")).select(
        "item_id", (F.size("missing") == 0).cast("int").alias("complete"),
        F.array_join("missing", ",").alias("missing"))


def _flags(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    items = inputs.generation_items(spark, sf)
    verdicts = judge.parse_verdicts(inputs.judge_replies(items).select(*keys, "metric", "raw"))
    return judge.item_flags(judge.with_unjudged(verdicts, items, keys), keys)


def error_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    flags = _flags(spark, sf, ["item_id"])
    return flags.select("item_id", *[F.col(c).cast("int").alias(c) for c in ["judged", *judge.FLAGS]])


def error_counters(spark: SparkSession, sf: str) -> DataFrame:
    return judge.error_counters(_flags(spark, sf, ["item_id"]))


def accuracy_report(spark: SparkSession, sf: str) -> DataFrame:
    return judge.accuracy_report(error_counters(spark, sf))


def eval_by_config(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy per run, the two tasks side by side."""
    run = ["model", "topic", "task", "pref_form"]
    counters = judge.error_counters(_flags(spark, sf, ["item_id", *run]), run)
    report = judge.accuracy_report(counters, run)
    return report.groupBy("model", "topic", "pref_form").pivot("task", ["cot", "zero-shot"]).agg(
        F.first("total").alias("total"), F.first("preference_following_pct").alias("following"),
        F.first("quality_aware_pct").alias("quality"),
    ).withColumnsRenamed({f"zero-shot_{c}": f"zero_shot_{c}" for c in ("total", "following", "quality")})


def scan_by_config(spark: SparkSession, sf: str) -> DataFrame:
    """Results written by run; those of one task are found again by their folders."""
    run = {"pref_form": "explicit", "task": "cot"}
    keys = ["item_id", *exchange.RUN_KEYS]
    path = new_path(spark, "runs")
    exchange.write_runs(_flags(spark, sf, keys), path)
    found = exchange.read_run(spark, path, **run)
    return found.select("item_id", *exchange.RUN_KEYS, F.col("judged").cast("int").alias("judged"),
                        F.col("preference_adherence_accuracy").cast("int").alias("adherent"))


QUERIES = {f.__name__: f for f in (
    accuracy_report, rubric_scan, items_x_rubrics, render_judge_prompt, pending_evaluations,
    judge_request_batch, reply_ingest, parse_verdict, hallucination_prompt_join, coverage_check, coverage_missing,
    verdict_pivot, all_metrics_present, error_taxonomy, error_counters, eval_by_config, scan_by_config)}


def _templates(closing: str = "") -> str:
    rows = ", ".join(f"({sql.lit(m)}, {sql.lit(t + closing)})" for m, t in prompts.RUBRICS.items())
    return f"templates(metric, template) AS (VALUES {rows})"


REPLACED = """CASE
  WHEN p.metric = 'acknow' THEN replace(replace(template, '{end_generation}', response_to_q), '{question}', question)
  WHEN p.metric = 'hallucinate' THEN replace(replace(template, '{preference}', preference),
    '{assistant_restatement}', restatement)
  ELSE replace(replace(replace(template, '{preference}', preference), '{question}', question),
    '{end_generation}', response_to_q) END"""

REQUESTS = f"""{sql.VERDICTS}, {_templates()},
done AS (SELECT * FROM verdicts WHERE z <> 10),
quoted AS (SELECT item_id, extract_pref AS restatement FROM done WHERE metric = 'acknow'),
wanted AS (SELECT item_id, metric, preference, question, response_to_q FROM items, metrics
  WHERE response_to_q IS NOT NULL),
prompted AS (SELECT p.item_id, p.metric, {REPLACED} AS prompt,
    NOT EXISTS (SELECT 1 FROM done d WHERE d.item_id = p.item_id AND d.metric = p.metric) AS is_pending
  FROM wanted p JOIN templates t ON t.metric = p.metric LEFT JOIN quoted q ON q.item_id = p.item_id
  WHERE p.metric <> 'hallucinate' OR restatement IS NOT NULL)"""

COUNTED = ", ".join(f"count(*) FILTER (judged AND {f}) AS {f}" for f in judge.FLAGS)
RATED = ", ".join(
    f"round(CASE WHEN total > 0 THEN {c}::DOUBLE / total * 100 END, 2) AS {name}"
    for name, c in judge.ACCURACIES.items())

ORACLES = {
    "accuracy_report": f"""WITH {sql.FLAGS}, counted AS (SELECT count(*) AS total, {COUNTED} FROM flags)
        SELECT *, {RATED} FROM counted""",
    "rubric_scan": f"""WITH {sql.ITEMS}, {_templates(chr(10))}
        SELECT t.metric, t.template, count(*) AS items FROM items, templates t
        WHERE response_to_q IS NOT NULL GROUP BY t.metric, t.template""",
    "items_x_rubrics": f"""WITH {sql.ITEMS}, {_templates()}
        SELECT item_id, topic, t.metric, t.template FROM items, templates t""",
    "render_judge_prompt": f"WITH {REQUESTS} SELECT item_id, metric, prompt FROM prompted",
    "pending_evaluations": f"""WITH {sql.REPLIES}
        SELECT i.item_id, m.metric FROM items i, metrics m WHERE response_to_q IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM replies r WHERE r.item_id = i.item_id AND r.metric = m.metric AND r.z <> 10)""",
    "judge_request_batch": f"""WITH {REQUESTS}
        SELECT item_id, metric, '{MODEL}' AS model, 0 AS stream, 1024 AS max_tokens, 0.0::DOUBLE AS temperature,
          {sql.lit(prompts.JUDGE_SYSTEM)} AS system, prompt FROM prompted WHERE is_pending""",
    "reply_ingest": f"""WITH {sql.REPLIES}
        SELECT item_id, metric, CASE WHEN z IN (8, 9) OR metric = 'thoughtful' THEN '' ELSE raw END AS raw
        FROM replies""",
    "parse_verdict": f"WITH {sql.VERDICTS} SELECT item_id, metric, answer, explanation, extract_pref FROM verdicts",
    "hallucination_prompt_join": f"""WITH {sql.VERDICTS}
        SELECT item_id, preference, extract_pref FROM verdicts WHERE metric = 'acknow'""",
    "coverage_check": f"""WITH {sql.ITEMS}
        SELECT pref_form, task, topic, model, count(response_to_q) FILTER (item_id % 13 <> 5) AS responses,
          count(*) AS expected, (count(response_to_q) FILTER (item_id % 13 <> 5) = count(*))::INTEGER AS complete
        FROM items GROUP BY ALL""",
    "coverage_missing": f"""WITH {sql.ITEMS}
        SELECT item_id, topic FROM items WHERE response_to_q IS NULL OR item_id % 13 = 5""",
    "verdict_pivot": f"""WITH {sql.VERDICTS}
        SELECT item_id, {', '.join(
            f"max(answer) FILTER (metric = '{m}') AS {m}, "
            f"max({'extract_pref' if m == 'acknow' else 'explanation'}) FILTER (metric = '{m}') AS {m}_text"
            for m in prompts.METRICS)}
        FROM verdicts GROUP BY item_id""",
    "all_metrics_present": f"""WITH {sql.REPLIES}
        SELECT item_id, bool_and(z <> 10)::INTEGER AS complete,
          coalesce(string_agg(metric, ',' ORDER BY k) FILTER (z = 10), '') AS missing
        FROM replies GROUP BY item_id HAVING bool_or(z <> 10)""",
    "error_taxonomy": f"""WITH {sql.FLAGS}
        SELECT item_id, judged::INTEGER AS judged, {', '.join(f'{f}::INTEGER AS {f}' for f in judge.FLAGS)} FROM flags""",
    "error_counters": f"WITH {sql.FLAGS} SELECT {COUNTED}, count(*) AS total FROM flags",
    "eval_by_config": f"""WITH {sql.FLAGS}, counted AS (
          SELECT model, topic, task, pref_form, count(*) AS total, {COUNTED} FROM flags GROUP BY ALL),
        rated AS (SELECT *, {RATED} FROM counted)
        SELECT model, topic, pref_form, {', '.join(
            f"max({c}) FILTER (task = '{t}') AS {t.replace('-', '_')}_{n}" for t in ("cot", "zero-shot")
            for n, c in (("total", "total"), ("following", "preference_following_pct"),
                         ("quality", "quality_aware_pct")))}
        FROM rated GROUP BY model, topic, pref_form""",
    "scan_by_config": f"""WITH {sql.FLAGS}
        SELECT item_id, pref_form, task, topic, model, judged::INTEGER AS judged,
          preference_adherence_accuracy::INTEGER AS adherent FROM flags
        WHERE pref_form = 'explicit' AND task = 'cot'""",
}
