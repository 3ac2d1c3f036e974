"""Judge evaluation: requests, verdicts, error taxonomy, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions import prompts
from stepwright.functions.prompts import METRICS
from stepwright.functions.text import tag_text

MAX_JUDGE_TOKENS = 1024  # fixed value: reply budget of a judge call
CRITIQUE_STOP = prompts.TURN_END


def checked_templates(rubrics: DataFrame) -> DataFrame:
    """The eight templates; a metric without one, or with two different ones, is an error."""
    known = rubrics.where(F.col("metric").isin(METRICS)).select("metric", "template").distinct()
    found = [r.metric for r in known.limit(2 * len(METRICS)).collect()]
    wrong = [m for m in METRICS if found.count(m) != 1]
    if wrong:
        raise ValueError(f"not exactly one template for: {', '.join(wrong)}")
    return known


def attach_templates(pairs: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Pairs with their metric's template, of which there are eight to broadcast."""
    return pairs.join(F.broadcast(checked_templates(rubrics)), "metric")


# The word looked for in a metric's lower-cased answer.
ANSWER_WORDS = {m: "no" if m == "helpful" else "yes" for m in METRICS}
_LAST_REPLY = 1 << 61


def holds_word() -> Column:
    """Whether an answer holds its metric's word; not, for other metrics and null answers."""
    said = F.lower("answer")
    return F.coalesce(F.when(F.col("metric") == "helpful", said.contains(ANSWER_WORDS["helpful"])).when(
        F.col("metric").isin(METRICS), said.contains(ANSWER_WORDS["violate"])), F.lit(False))


def verdict_order(verdicts: DataFrame) -> Column:
    """What decides first between verdicts of one pair, as one number: `reply_no`, doubled, plus `holds_word`.

    So the smallest `reply_no` counts, one that is null or missing comes last, and of
    equal ones an answer without the word counts. The number is odd if the answer that
    counts holds the word: flags need its minimum only.
    """
    number = F.col("reply_no").cast("bigint") if "reply_no" in verdicts.columns else F.lit(None).cast("bigint")
    last = F.lit(_LAST_REPLY)
    return 2 * F.greatest(-last, F.least(F.coalesce(number, last), last)) + holds_word().cast("bigint")


def first_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict for each (item_id, metric), the first by `verdict_order`, then by the hash of its fields.

    Rows are dealt out by item, so that what groups by item next needs no other shuffle.
    """
    values = [c for c in ("answer", "explanation", "extract_pref") if c in verdicts.columns]
    order = Window.partitionBy("item_id", "metric").orderBy("_order", F.xxhash64(*values))
    return verdicts.withColumn("_order", verdict_order(verdicts)).repartition("item_id").withColumn(
        "_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_order")


def with_rubrics(items: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Every item with each of the eight metrics and the metric's template."""
    every = F.explode(F.array(*[F.lit(m) for m in METRICS]))
    return attach_templates(items.withColumn("metric", every), rubrics)


def has_reply(items: DataFrame) -> Column:
    """Whether an item has a reply: its `replied` flag, which spares reading the text, or the text."""
    return F.col("replied") if "replied" in items.columns else F.col("response_to_q").isNotNull()


def done_masks(verdicts: DataFrame) -> DataFrame:
    """(item_id, done): a bit for each metric, in order of METRICS, that an item has a verdict of.

    One small number an item, combined map-side. Verdicts of other metrics set no bit.
    """
    bit = F.coalesce(*[F.when(F.col("metric") == m, 1 << i) for i, m in enumerate(METRICS)], F.lit(0))
    return verdicts.groupBy("item_id").agg(F.bit_or(bit).alias("done"))


def metrics_open(done: Column) -> Column:
    """The metrics whose bit is not set; all of them for a null mask."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(done, F.lit(0)).bitwiseAND(1 << i) == 0, F.lit(m)) for i, m in enumerate(METRICS)]))


def pending(items: DataFrame, verdicts: DataFrame, *keep: str) -> DataFrame:
    """(item_id, *keep, metric) still to judge; items without a reply are left out.

    Masks meet items once by item; an item's open metrics are unpacked after that.
    """
    wanted = items.where(has_reply(items)).select("item_id", *keep)
    return wanted.join(done_masks(verdicts), "item_id", "left").select(
        "item_id", *keep, F.explode(metrics_open(F.col("done"))).alias("metric"))


def request_payload(model: str, prompt: Column, system: str = prompts.JUDGE_SYSTEM,
                    max_tokens: int = MAX_JUDGE_TOKENS) -> Column:
    """Body of a judge call as JSON text."""
    return F.to_json(F.struct(
        F.lit(model).alias("model"), F.lit(False).alias("stream"),
        F.array(prompts.message("system", F.lit(system)),
                prompts.message("user", prompt)).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"), F.lit(0.0).alias("temperature")))


def critique_payload(model: str, prompt: Column, max_tokens: int = MAX_JUDGE_TOKENS) -> Column:
    """Body of a critique call as JSON text."""
    return F.to_json(F.struct(
        F.lit(model).alias("model"), prompt.alias("prompt"), F.lit(max_tokens).alias("max_tokens"),
        F.lit(0.0).alias("temperature"), F.array(F.lit(CRITIQUE_STOP)).alias("stop")))


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """Replies (`raw`) to verdicts; `acknow` quotes a preference, the others explain."""
    acknow = F.col("metric") == "acknow"
    return replies.withColumns({
        "answer": tag_text(F.col("raw"), "answer"),
        "explanation": F.when(~acknow, tag_text(F.col("raw"), "explanation")),
        "extract_pref": F.when(acknow, tag_text(F.col("raw"), "preference")),
    }).drop("raw")


def restatement_pairs(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items with the preference the first `acknow` verdict quoted, for the hallucination check."""
    return items.join(quoted_preferences(verdicts), "item_id")


def quoted_preferences(verdicts: DataFrame) -> DataFrame:
    """(item_id, extract_pref) of the first `acknow` verdict of each item."""
    return first_verdicts(verdicts.where(F.col("metric") == "acknow")).select("item_id", "extract_pref")


def verdict_records(verdicts: DataFrame) -> DataFrame:
    """One row per item: `verdicts`, metric to its first verdict (answer, explanation, extract_pref).

    What is collected per item are the metrics' first verdicts, eight at most.
    """
    names = ("answer", "explanation", "extract_pref")
    fields = F.struct(*[F.col(c) if c in verdicts.columns else F.lit(None).cast("string").alias(c) for c in names])
    known = first_verdicts(verdicts.where(F.col("metric").isin(METRICS)))
    return known.groupBy("item_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("metric"), fields))).alias("verdicts"))


def verdict_pivot(verdicts: DataFrame) -> DataFrame:
    """One row per item, per metric its answer, and the explanation or quoted preference as `_text`."""
    def field(m: str, name: str) -> Column:
        return F.try_element_at("verdicts", F.lit(m))[name]

    return verdict_records(verdicts).select("item_id", *[c for m in METRICS for c in (
        field(m, "answer").alias(m),
        field(m, "extract_pref" if m == "acknow" else "explanation").alias(f"{m}_text"))])


def write_verdict_records(verdicts: DataFrame, path: str) -> None:
    """The per-item records as JSON lines: metric to its verdict, without fields that it lacks."""
    verdict_records(verdicts).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def missing_metrics(answers: Column) -> Column:
    """Metrics absent from a metric-to-verdict map."""
    return F.array_except(F.array(*[F.lit(m) for m in METRICS]), F.map_keys(answers))


def taxonomy(said: dict[str, Column]) -> dict[str, Column]:
    """Error and quality flags from "the answer holds the metric's word" booleans."""
    ack, vio, unhelpful = said["acknow"], said["violate"], said["helpful"]
    hal = ack & said["hallucinate"]
    open_violation = vio & ~unhelpful
    inconsistent = ack & ~hal & open_violation
    hallucinated = hal & open_violation
    unaware = ~ack & open_violation
    return {
        "acknowledgement": ack,
        "hallucination": hal,
        "violation": vio,
        "error_unhelpful": unhelpful,
        "error_inconsistent": inconsistent,
        "hallucination_of_preference_violation": hallucinated,
        "preference_unaware_violation": unaware,
        "preference_adherence_accuracy": ~(inconsistent | hallucinated | unaware | unhelpful),
        "innovative": said["innovative"],
        "misleading": said["misleading"],
        "deep_mining": said["deep_mining"],
        "thoughtful": said["thoughtful"],
        "quality_aware_accuracy": said["innovative"] | said["deep_mining"] | said["thoughtful"],
    }


# The counters, in report order.
FLAGS = [
    "acknowledgement", "hallucination", "violation", "error_unhelpful", "error_inconsistent",
    "hallucination_of_preference_violation", "preference_unaware_violation",
    "preference_adherence_accuracy", "innovative", "misleading", "deep_mining", "thoughtful",
    "quality_aware_accuracy",
]


def item_flags(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict rows to one row of flags per item.

    Of repeated verdicts the first counts, by `verdict_order`, of which the least
    is kept: one number a metric, so it combines map-side. A row with a NULL metric
    only says that the item exists; `judged` is false when an item has no others.
    """
    verdicts = verdicts.withColumn("_order", verdict_order(verdicts))
    said = [F.min(F.when(F.col("metric") == m, F.col("_order"))).alias(f"_{m}") for m in METRICS]
    judged = F.max(F.col("metric").isNotNull()).alias("judged")
    wide = verdicts.groupBy(*keys).agg(judged, *said)
    flags = taxonomy({m: F.coalesce(F.col(f"_{m}").bitwiseAND(1) == 1, F.lit(False)) for m in METRICS})
    return wide.select(*keys, "judged", *[c.alias(name) for name, c in flags.items()])


def with_unjudged(verdicts: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict rows plus one NULL-metric row per item, so that unjudged items count."""
    numbered = [c for c in ("reply_no",) if c in verdicts.columns]
    presence = items.select(*keys)
    for c in ("metric", "answer", *numbered):
        presence = presence.withColumn(c, F.lit(None).cast(verdicts.schema[c].dataType))
    return verdicts.select(*keys, "metric", "answer", *numbered).unionByName(presence)


def error_counters(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Thirteen counters over judged items, and the total over all items."""
    counters = [F.count_if(F.col("judged") & F.col(name)).alias(name) for name in FLAGS]
    return flags.groupBy(*(by or [])).agg(*counters, F.count(F.lit(1)).alias("total"))


# Reported percentage per counter.
ACCURACIES = {
    "preference_following_pct": "preference_adherence_accuracy",
    "quality_aware_pct": "quality_aware_accuracy",
    "innovative_pct": "innovative",
    "deep_mining_pct": "deep_mining",
    "thoughtful_pct": "thoughtful",
}


def accuracy_report(counters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters with their percentages of the total; NULL for an empty total."""
    rates = [F.round(F.try_divide(F.col(c), F.col("total")) * 100, 2).alias(name)
             for name, c in ACCURACIES.items()]
    return counters.select(*(by or []), "total", *FLAGS, *rates)


def coverage(expected: DataFrame, items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Replies in the generations against the rows of the topic table, and whether their numbers match.

    `expected` has a row for each item that was to be generated, `items` is what was.
    """
    by = by or []
    rows = expected.select(*by, F.lit(1).alias("_expected"), F.lit(0).alias("_replied")).unionByName(
        items.select(*by, F.lit(0).alias("_expected"), has_reply(items).cast("int").alias("_replied")))
    return rows.groupBy(*by).agg(F.sum("_replied").alias("responses"), F.sum("_expected").alias("expected")).withColumn(
        "complete", F.col("responses") == F.col("expected"))


def missing_items(expected: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows for which the generations have no reply."""
    return expected.join(items.where(has_reply(items)).select(*keys), keys, "left_anti")
