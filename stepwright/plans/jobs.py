"""End-to-end jobs over folders of JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.functions import prompts
from stepwright.functions.arrays import as_rows
from stepwright.functions.steps import earlier_steps, with_completion_steps
from stepwright.functions.text import parse_score
from stepwright.operators import corpus, judge, rewards
from stepwright.sources import json_files, rubrics, schemas
from stepwright.sources.workspace import written


def enumerate_paths(spark: SparkSession, folder: str, output: str) -> None:
    """Thought-tree files to process records, one JSON line per root-to-leaf path."""
    records = json_files.good_records(json_files.read_json_arrays(spark, folder, schemas.THOUGHT_TREE))
    paths = corpus.tree_paths(records).select("idx", "question", "preference", "process", "label", "final_score")
    json_files.write_json_lines(paths, output, numbers=("final_score",))


def clean_processes(spark: SparkSession, path: str, output: str) -> None:
    """Process records capped at five steps, with the score in the closing critique."""
    rows = json_files.good_records(json_files.read_json_lines(spark, path, schemas.PROCESS))
    json_files.write_json_lines(corpus.clean_process(rows).drop("source_file"), output, numbers=("final_score",))


def cap_response_files(spark: SparkSession, folder: str, output: str) -> None:
    """Multi-response files with every response capped, one folder per file."""
    items = json_files.good_records(json_files.read_json_arrays(spark, folder, schemas.RESPONSES))
    capped = items.withColumn("response_list", corpus.cap_responses(F.col("response_list"))).drop("idx")
    json_files.write_by_file(capped, output, "source_file")


def split_files(spark: SparkSession, folder: str, output: str, schema: str, seed: int = 42) -> None:
    """Every file of a folder split into train and test, files of equal length alike."""
    items = json_files.good_records(json_files.read_json_arrays(spark, folder, schema))
    marked = corpus.seeded_split(items, "source_file", "idx", seed).drop("idx")
    json_files.write_by_file(marked, output, "split", "source_file")


def policy_examples(spark: SparkSession, folder: str, output: str) -> None:
    """A training triple per response, all files in one collection."""
    items = json_files.good_records(json_files.read_json_arrays(spark, folder, schemas.RESPONSES))
    json_files.write_json_lines(corpus.explode_responses(items).select("instruction", "input", "output"), output)


def critique_examples(processes: DataFrame, template: str = prompts.ASSISTANT_TEMPLATE,
                      instruction: str = prompts.CRITIQUE_INSTRUCTION) -> DataFrame:
    """Process records to chats, one per step, for training the critique model."""
    prompt = prompts.fill(template, preference=F.col("preference"), question=F.col("question"))
    return corpus.step_examples(processes).select(prompts.critique_messages(
        prompt, F.col("context"), F.col("step"), F.col("critique"), instruction).alias("messages"))


def judge_requests(items: DataFrame, verdicts: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Prompts of all pairs that can be judged now.

    The hallucination check shows the preference the `acknow` verdict quoted
    and so waits for that verdict; ask again once it is in.
    """
    # all three meet by item, before an item becomes several rows
    quoted = items.join(judge.quoted_preferences(verdicts), "item_id", "left")
    due = judge.pending(quoted, verdicts, "preference", "question", "response_to_q", "extract_pref")
    ready = due.where((F.col("metric") != "hallucinate") | F.col("extract_pref").isNotNull())
    templates = rubrics.default_rubrics(items.sparkSession) if templates is None else templates
    return judge.attach_templates(ready, templates).select("item_id", "metric", prompts.fill_rubric(
        F.col("template"), F.col("metric"), F.col("preference"), F.col("question"),
        F.col("response_to_q"), F.col("extract_pref")).alias("prompt"))


def accuracy(items: DataFrame, verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters and percentages over all items, per run configuration when `by` names it."""
    by = by or []
    keys = ["item_id", *by]
    # verdicts of items that aren't asked about don't count
    rows = verdicts.drop(*by).join(items.select(*keys), "item_id") if by else verdicts.join(
        items.select("item_id"), "item_id", "left_semi")
    flags = judge.item_flags(judge.with_unjudged(rows, items, keys), keys)
    return judge.accuracy_report(judge.error_counters(flags, by), by)


def critique_requests(completions: DataFrame, model: str = "reward_model",
                      instruction: str = prompts.CRITIQUE_INSTRUCTION) -> DataFrame:
    """(prompt_id, gen, step_no, body): the request to critique each step of (prompt_id, gen, prompt, completion).

    A step is shown after the prompt and all steps before it, as a chat that
    the critique model is to go on with.
    """
    split = with_completion_steps(completions, "completion").select(
        *rewards.COMPLETION, "prompt", "steps", F.posexplode(as_rows(F.col("steps"))).alias("step_no", "step"))
    content = prompts.critique_input(
        F.col("prompt"), earlier_steps(F.col("steps"), F.col("step_no"), "\n"), F.col("step"), instruction)
    chat = prompts.chat_text(F.array(prompts.message("user", content)), generation_prompt=True)
    return split.select(*rewards.COMPLETION, "step_no", judge.critique_payload(model, chat).alias("body"))


def score_rollouts(completions: DataFrame, replies: DataFrame, eos: str) -> DataFrame:
    """The log of a rollout: mean reward and advantage of each completion.

    `completions` are (batch_id, prompt_id, gen, prompt, completion), `replies`
    (prompt_id, gen, step_no, raw) what the critique model answered. A step
    without a reply or a score has 0.0; of repeated ones the largest counts.
    """
    scores = replies.select(*rewards.COMPLETION, "step_no", parse_score(F.col("raw")).alias("score"))
    rows = completions.select("batch_id", *rewards.COMPLETION, "prompt", "completion")
    scored = written(rewards.token_rewarded(rows, scores, eos), "rollouts")  # read for groups and for rows
    return rewards.rollout_log(rewards.group_advantages(scored))
