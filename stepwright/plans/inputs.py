"""Inputs of the registered queries, derived row by row from the given tables.

Whole tables and whole texts go in; FIXTURES.md describes the shapes. The same
derivations in SQL are in `oracle_inputs.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.functions.arrays import bind
from stepwright.functions.prompts import METRICS
from stepwright.functions.steps import with_completion_steps
from stepwright.functions.text import STEP_SEPARATOR, parse_score, words
from stepwright.functions.tokens import eos_mask
from stepwright.operators.judge import parse_verdicts
from stepwright.operators.rewards import aligned_scores, token_rewarded, with_scores
from stepwright.sources.tables import table
from stepwright.sources.workspace import written

EOS = "<eos>"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def preference() -> Column:
    return F.concat(F.lit("prefers "), F.col("lang"), F.lit(" from "), F.col("source"))


def first_line() -> Column:
    return F.substring_index("text", "\n", 1)


def tenth(number: Column) -> Column:
    """-1.0 .. 1.0 in tenths."""
    return (F.pmod(number, F.lit(21)) - 10) / F.lit(10.0)


def pieces(count: Column) -> Column:
    """The text cut into `count` pieces of equal length, the last ones maybe shorter or empty."""
    width = F.floor((F.length("text") + count - 1) / count).cast("int")
    return bind(width, lambda w: F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.substring(
        F.col("text"), i * w + 1, w)))


def numbered(texts: Column) -> Column:
    return F.transform(texts, lambda t, i: F.concat(
        F.lit("Step "), (i + 1).cast("string"), F.lit(": "), t))


def tree_records(spark: SparkSession, sf: str) -> DataFrame:
    """A thought tree per document: line n's children are lines 3n+1..3n+3.

    The last inner line may list lines that do not exist, and every fifth line
    behind it lists only one such, so that its branch yields nothing.
    """
    n = F.size("lines")

    def children(i: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda c: (3 * i + c).cast("string"))
        nowhere = F.array((n + i).cast("string"))
        return F.when(3 * i + 1 < n, inner).when((i + 1) % 5 == 0, nowhere).otherwise(
            F.array().cast("array<string>"))

    def node(line: Column, i: Column) -> Column:
        score = tenth(F.col("doc_id") + i)
        return F.struct(i.cast("string").alias("key"), F.struct(
            children(i).alias("children"), line.alias("thought"),
            F.concat(F.lit("on "), line).alias("reasoning"), score.alias("score")).alias("value"))

    lines = documents(spark, sf).select(
        "doc_id", "lang", "source", F.split("text", "\n").alias("lines"))
    return lines.select(
        F.col("doc_id").alias("idx"), F.get("lines", F.lit(0)).alias("initial_question"),
        preference().alias("user_profile"),
        F.map_from_entries(F.transform("lines", node)).alias("thought_tree"))


def processes(spark: SparkSession, sf: str) -> DataFrame:
    """A process of 1..7 steps per document; some have a label too many, some no score."""
    k = F.col("doc_id") % 7 + 1
    n_labels = F.col("k") + F.when(F.col("source") == "src7", 1).otherwise(0)
    last = F.least(F.col("n_labels"), F.lit(5))
    label = F.transform(F.sequence(F.lit(1), F.col("n_labels").cast("int")), lambda i: F.struct(
        F.when(i == F.col("last"), "Final Answer Node.").otherwise(
            F.concat(F.lit("critique "), i.cast("string"))).alias("critique"),
        tenth(F.col("doc_id") + i).alias("score")))
    score = F.when(F.col("source") != "src3", tenth(F.col("doc_id")))
    return (
        documents(spark, sf).withColumn("k", k).withColumn("n_labels", n_labels).withColumn("last", last)
        .select(F.col("doc_id").alias("idx"), first_line().alias("question"),
                preference().alias("preference"),
                F.array_join(numbered(pieces(F.col("k"))), STEP_SEPARATOR).alias("process"),
                label.alias("label"), score.alias("final_score"))
    )


def multi_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Three responses per document, of 1..7 step strings each; some without a score."""
    def response(r: int) -> Column:
        return F.struct(
            numbered(pieces((F.col("doc_id") + 2 * r) % 7 + 1)).alias("response"),
            F.lit("as given").alias("answer"),
            F.when((F.col("doc_id") + r) % 4 != 0, tenth(F.col("doc_id") * (r + 1))).alias("score"))

    return documents(spark, sf).select(
        "doc_id", preference().alias("user_profile"), first_line().alias("initial_question"),
        F.array(*[response(r) for r in range(3)]).alias("response_list"))


def generation_items(spark: SparkSession, sf: str) -> DataFrame:
    """A judged item per document and its run configuration; one source has no replies yet."""
    return generation_items_of(documents(spark, sf))


def generation_items_of(docs: DataFrame) -> DataFrame:
    return docs.withColumn("replied", F.col("source") != "src13").select(
        F.col("doc_id").alias("item_id"), preference().alias("preference"),
        first_line().alias("question"),
        F.when(F.col("replied"), F.col("text")).alias("response_to_q"), "replied",
        F.col("source").alias("model"), F.col("lang").alias("topic"),
        F.when(F.col("doc_id") % 2 == 0, "cot").otherwise("zero-shot").alias("task"),
        F.lit("explicit").alias("pref_form"))


def judge_replies(items: DataFrame) -> DataFrame:
    """Eight raw judge replies per item with a reply; some carry no tags or a vague answer."""
    spread = items.where(F.col("replied")).select(
        "*", F.posexplode(F.array(*[F.lit(m) for m in METRICS])).alias("k", "metric"))
    i, k = F.col("item_id"), F.col("k")
    z = (i * (k + 1) + F.floor(i / 7) * (2 * k + 3) + k * k) % 11
    said = F.when(F.col("z") <= 5, "Yes").when(F.col("z") <= 8, "NO").otherwise("cannot say")
    tag = F.when(F.col("metric") == "acknow", "preference").otherwise("explanation")
    raw = F.when(F.col("z") == 10, F.concat(F.lit("no tags here: "), "response_to_q")).otherwise(
        F.concat(F.lit("<"), tag, F.lit("> "), "response_to_q", F.lit(" </"), tag,
                 F.lit("><Answer> "), said, F.lit(" </Answer>")))
    return spread.withColumn("z", z).withColumn("raw", raw)


def finished_verdicts(items: DataFrame) -> DataFrame:
    """Verdicts of the replies that carried tags; the others are still to be judged."""
    return parse_verdicts(judge_replies(items).where(F.col("z") != 10)).select(
        "item_id", "metric", "answer", "explanation", "extract_pref")


def completions(spark: SparkSession, sf: str) -> DataFrame:
    """A completion per document, its text set out with step markers in five patterns."""
    p = [F.get("p", F.lit(i)) for i in range(6)]

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    kind = F.col("doc_id") % 5
    completion = (
        F.when(kind == 0, text("Preamble ", p[0], " Step 1: ", p[1], p[2], " Step 2: ", p[3], p[4], p[5],
                               f" {EOS}"))
        .when(kind == 1, F.col("text"))
        .when(kind == 2, text("Step 3: ", p[0], p[1], p[2], f" {EOS} Step 4: ", p[3], p[4], p[5], f" {EOS}"))
        .when(kind == 3, text("Step 1: ", p[0], " Step 1: ", p[1], " Step 3: ", p[2], " Step 2: ", p[3],
                              " Step 9: ", p[4], "tail", p[5]))
        .otherwise(text("Step 1: ", p[0], " Step 2: ", p[1], "Step 3: ", p[2], " Step 4: ", p[3],
                        " Step 5: ", p[4], " Step 6: ", p[5], f" {EOS}"))
    )
    group = F.floor(F.col("doc_id") / 4)
    return documents(spark, sf).withColumn("p", pieces(F.lit(6))).select(
        F.floor(F.col("doc_id") / 32).alias("batch_id"), (group % 2).alias("shard"),
        group.alias("prompt_id"), (F.col("doc_id") % 4).cast("int").alias("gen"),
        F.concat(preference(), F.lit(": "), first_line()).alias("prompt"),
        completion.alias("completion"))


def critique_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Raw critiques of the first three steps of every completion; some give no score."""
    i, step = F.col("doc_id"), F.col("step_no")
    number = ((i + 5 * step) % 21 - 10).cast("string")
    raw = F.when((i + step) % 4 == 0, F.concat(F.lit("none: "), "text")).otherwise(F.concat(
        F.lit("**Reasoning:** "), "text", F.lit(" **Score:** "), number, F.lit(".5 **SCORE:** 9")))
    return documents(spark, sf).select(
        F.floor(i / 4).alias("prompt_id"), (i % 4).cast("int").alias("gen"), "doc_id", "text",
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step_no")).select(
        "prompt_id", "gen", "step_no", raw.alias("raw"))


def scored_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completions with their steps and aligned step scores."""
    scores = critique_replies(spark, sf).select(
        "prompt_id", "gen", "step_no", parse_score(F.col("raw")).alias("score"))
    steps = with_completion_steps(with_scores(completions(spark, sf), scores), "completion")
    return steps.withColumn("scores", aligned_scores(F.col("steps"), F.col("scores")))


def rewarded(spark: SparkSession, sf: str) -> DataFrame:
    """Scored completions with per-token rewards and the end-token mask."""
    scores = critique_replies(spark, sf).select(
        "prompt_id", "gen", "step_no", parse_score(F.col("raw")).alias("score"))
    return token_rewarded(completions(spark, sf).drop("shard"), scores, EOS)


def rollouts(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The rewards, written once: group statistics and the join back to them both read it."""
    return written(rewarded(spark, sf).select("batch_id", "prompt_id", "gen", "rewards", *columns), "rollouts")


def token_signals(spark: SparkSession, sf: str) -> DataFrame:
    """A row per token of every completion with logged signals."""
    tokens = completions(spark, sf).withColumn("tokens", words(F.col("completion"))).withColumn(
        "mask", eos_mask(F.col("tokens"), F.lit(EOS)))
    rows = tokens.select("batch_id", "shard", "prompt_id", "gen", F.posexplode(
        F.arrays_zip("tokens", "mask")).alias("pos", "t"))
    doc = F.col("prompt_id") * 4 + F.col("gen")
    n, pos = F.length("t.tokens"), F.col("pos")

    def logged(seed: Column) -> Column:
        return -(1 + (seed + n + pos) % 9) / F.lit(10.0)

    return rows.select(
        "batch_id", "shard", "prompt_id", "gen", "pos", F.col("t.mask").alias("mask"),
        (((doc * 7 + pos * 3) % 21 - 10) / F.lit(10.0)).alias("adv"),
        logged(doc).alias("logp"), logged(doc * 3).alias("old_logp"), logged(doc * 5).alias("ref_logp"),
        ((doc * 11 + n * 37 + pos) % 97 / F.lit(16.0)).alias("entropy"))


def metric_points(spark: SparkSession, sf: str) -> DataFrame:
    """Events as metric points; errors are logged in eval mode."""
    events = table(spark, sf, "events")
    return events.select(
        F.when(F.col("event_type") == "error", "eval").otherwise("train").alias("mode"),
        F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value", "ts")
