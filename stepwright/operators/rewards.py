"""Process rewards: step scores to token rewards to group-relative advantages.

A rollout is one row: (batch_id, prompt_id, gen, tokens, rewards, ...), with one
array entry per token. Only group statistics leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.functions.arrays import as_rows, bind
from stepwright.functions.steps import MAX_STEPS, with_completion_steps
from stepwright.functions.text import words
from stepwright.functions.tokens import eos_mask, find_framed, framed_size, framed_text

STD_OFFSET = 1e-8  # fixed value: added to the deviation before dividing
COMPLETION = ["prompt_id", "gen"]


def replicate(prompts: DataFrame, n: int) -> DataFrame:
    """`n` generations per prompt, numbered from 0."""
    return prompts.withColumn("gen", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def every_nth(rows: DataFrame, position: str, n: int) -> DataFrame:
    """The inverse: every n-th row of prompts repeated n times in a row."""
    return rows.where(is_nth(position, n))


def is_nth(position: str, n: int) -> Column:
    """Whether a row is the first of its n copies."""
    return F.col(position) % n == 0


def step_scores(step_rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Every step with its score, 0.0 where no critique came back; of repeated scores the largest."""
    keys = COMPLETION + ["step_no"]
    one = scores.groupBy(*keys).agg(F.max("score").alias("score"))
    return step_rows.join(one, keys, "left").fillna(0.0, ["score"])


def score_arrays(scores: DataFrame) -> DataFrame:
    """Score rows to one array of MAX_STEPS scores per completion, NULL where missing.

    One numeric aggregate per step keeps the buffer fixed however often a
    score was logged; of repeated ones the largest counts.
    """
    per_step = [F.max(F.when(F.col("step_no") == i, F.col("score"))).alias(f"_s{i}")
                for i in range(MAX_STEPS)]
    return scores.groupBy(*COMPLETION).agg(*per_step).select(
        *COMPLETION, F.array(*[F.col(f"_s{i}") for i in range(MAX_STEPS)]).alias("scores"))


def with_scores(completions: DataFrame, scores: DataFrame) -> DataFrame:
    """Completions with their score array; join before splitting, to shuffle the text once."""
    return completions.join(score_arrays(scores), COMPLETION, "left")


def token_rewarded(completions: DataFrame, scores: DataFrame, eos: str) -> DataFrame:
    """Completions (`completion`, keys, ...) with their per-token rewards and end-token mask.

    The text is shuffled once, to meet its step scores; all else is in the row.
    """
    split = with_completion_steps(with_scores(completions, scores), "completion").withColumn(
        "scores", aligned_scores(F.col("steps"), F.col("scores"))).withColumn("frame", framed_text(F.col("completion")))
    frame = F.col("frame")
    spans = step_spans(frame, F.transform("steps", framed_text), F.col("scores"))
    return split.select(
        *completions.columns, token_rewards(framed_size(frame), spans).alias("rewards"),
        eos_mask(words(F.col("completion")), F.lit(eos)).alias("mask"))


def span_rows(completions: DataFrame, scores: DataFrame) -> DataFrame:
    """(keys, step_no, first, after, score): a row for each scored step whose tokens occur in its completion."""
    split = with_completion_steps(with_scores(completions, scores), "completion").withColumn(
        "scores", aligned_scores(F.col("steps"), F.col("scores"))).withColumn("frame", framed_text(F.col("completion")))
    spans = step_spans(F.col("frame"), F.transform("steps", framed_text), F.col("scores"), numbered=True)
    return split.select(*COMPLETION, F.explode(as_rows(spans)).alias("s")).select(*COMPLETION, "s.*")


def token_rewards_by_rows(tokens: DataFrame, spans: DataFrame, keys: list[str], block: int = 64) -> DataFrame:
    """Token rows (keys, pos) with the score of the last span (keys, step_no, first, after, score) over each, else 0.0.

    For completions whose tokens don't fit in a row. Tokens become blocks of up to 64
    positions, a bit for each, combined map-side, so that one row moves for many tokens.
    The range join pos >= first and pos < after is one on blocks: a span is in all that it
    reaches into, so a long completion is dealt out over tasks. Tokens are unpacked after
    the join, where a block's spans decide without another shuffle.
    Tokens with a null key meet no span.
    """
    width = min(block, 64)
    kind = tokens.schema["pos"].dataType
    number = F.floor(F.col("pos") / width).alias("_block")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") - F.col("_block") * width).cast("int"))
    packed = tokens.select(*keys, "pos", number).groupBy(*keys, "_block").agg(F.bit_or(bit).alias("_bits"))
    # the last span comes first
    span = F.struct((-F.col("step_no")).alias("order"), "first", "after", "score").alias("_span")
    blocks = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("after") - 1) / width))
    reached = spans.where("after > first and step_no is not null").select(
        *keys, span, F.explode(blocks).alias("_block")).groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list("_span")).alias("_spans"))
    held = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(F.col("_bits"), i) == 1)
    places = F.transform(held, lambda i: (F.col("_block") * width + i).cast(kind))
    rows = packed.join(reached, [*keys, "_block"], "left").select(*keys, "_spans", F.explode_outer(places).alias("pos"))
    over = F.filter("_spans", lambda s: (F.col("pos") >= s["first"]) & (F.col("pos") < s["after"]))
    return rows.select(*keys, "pos", F.coalesce(F.get(over, F.lit(0))["score"], F.lit(0.0)).alias("reward"))


def aligned_scores(steps: Column, scores: Column) -> Column:
    """One score per step, 0.0 where none came back."""
    return F.transform(steps, lambda _, i: F.coalesce(F.get(scores, i), F.lit(0.0)))


def step_spans(completion: Column, steps: Column, scores: Column, numbered: bool = False) -> Column:
    """(first, after, score) of each step whose tokens occur in the completion, and its number from 0 if `numbered`.

    `completion` is framed text, `steps` an array of framed texts.
    """
    def span(step: Column, i: Column) -> Column:
        number = [i.alias("step_no")] if numbered else []
        return bind(find_framed(completion, step), lambda first: F.struct(
            *number, first.alias("first"), (first + framed_size(step)).alias("after"), F.get(scores, i).alias("score")))

    return F.filter(F.transform(steps, span), lambda s: s["first"] >= 0)


def token_rewards(size: Column, spans: Column) -> Column:
    """The rewards of `size` tokens: the score of the last step covering each, else 0.0.

    Step by step, a span's stretch of the array is replaced as a whole.
    """
    def put(rewards: Column, s: Column) -> Column:
        return F.concat(
            F.slice(rewards, F.lit(1), s["first"]),
            F.array_repeat(s["score"], s["after"] - s["first"]),
            F.slice(rewards, s["after"] + 1, F.size(rewards) - s["after"]))

    return F.aggregate(spans, F.array_repeat(F.lit(0.0), size), put)


def padded(rewards: Column, length: Column) -> Column:
    return F.concat(rewards, F.array_repeat(F.lit(0.0), F.greatest(length - F.size(rewards), F.lit(0))))


def batch_lengths(rollouts: DataFrame) -> DataFrame:
    """Longest completion per batch: the length all its rewards are padded to."""
    return rollouts.groupBy("batch_id").agg(F.max(F.size("rewards")).alias("max_len"))


def dense_rewards(rollouts: DataFrame) -> DataFrame:
    """Rewards padded with 0.0 to the longest completion of the batch."""
    lengths = batch_lengths(rollouts)
    return rollouts.join(lengths, "batch_id", "left").withColumn("rewards", padded(F.col("rewards"), F.col("max_len")))


def _merge_zeros(n: Column, mean: Column, m2: Column, size: Column) -> tuple[Column, Column]:
    """Mean and sample deviation of `n` values widened by zeros to `size` values."""
    full_mean = mean * n / size
    full_m2 = m2 + mean * mean * n * (size - n) / size
    return full_mean, F.when(size > 1, F.sqrt(full_m2 / (size - 1)))


def reward_runs(rewards: Column) -> Column:
    """(first, after, reward) of each stretch of equal rewards; a few per completion."""
    last = F.size(rewards) - 1
    begins = F.filter(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (F.get(rewards, i) != F.get(rewards, i - 1)))
    return bind(begins, lambda at: F.transform(at, lambda first, k: F.struct(
        first.alias("first"), F.coalesce(F.get(at, k + 1), last + 1).alias("after"),
        F.get(rewards, first).alias("reward"))))


def group_stats(rollouts: DataFrame) -> DataFrame:
    """Per prompt: its number of generations and (first, after, mean, std) of every stretch of positions.

    Within a stretch no generation's reward changes. What is shuffled is a row of
    a few runs per completion, and what a prompt gathers are the runs of its
    generations, a handful by design of a rollout. Gathered runs are laid out as
    arrays again, so that each stretch looks up one entry per generation: work is
    linear in tokens however often rewards change. Past a generation's end its
    rewards count as 0.0.
    """
    members = rollouts.select("batch_id", "prompt_id", reward_runs(F.col("rewards")).alias("runs")).groupBy(
        "batch_id", "prompt_id").agg(F.collect_list("runs").alias("members"))

    def ends(runs: Column) -> Column:
        return F.flatten(F.transform(runs, lambda r: F.array(r["first"], r["after"])))

    def laid_out(runs: Column) -> Column:
        return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["reward"], r["after"] - r["first"])))

    edges = F.sort_array(F.array_distinct(F.flatten(F.transform("members", ends))))

    def stretch(rewards: Column, first: Column, after: Column) -> Column:
        def stats(values: Column) -> Column:
            n = F.size(values)
            mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
            return bind(mean, lambda m: F.struct(
                first.alias("first"), after.alias("after"), m.alias("mean"),
                F.when(n > 1, F.sqrt(F.aggregate(
                    values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (n - 1))).alias("std")))

        values = F.transform(rewards, lambda r: F.coalesce(F.get(r, first), F.lit(0.0)))
        return bind(values, stats)

    def stretches(e: Column) -> Column:
        return bind(F.transform("members", laid_out), lambda rewards: F.transform(
            F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))),
            lambda first, i: stretch(rewards, first, F.get(e, i + 1))))

    return members.select(
        "batch_id", "prompt_id", F.size("members").alias("size"), bind(edges, stretches).alias("stats"))


def group_advantages(rollouts: DataFrame) -> DataFrame:
    """(reward - group mean) / (group deviation + 1e-8) per token position.

    Arrays reach to the group's longest completion; past it every reward is 0.0
    and so is every advantage. A group of one has no deviation, hence NULLs.
    """
    joined = rollouts.join(group_stats(rollouts).drop("size"), ["batch_id", "prompt_id"], "left")
    length = F.coalesce(F.array_max(F.transform("stats", lambda s: s["after"])), F.lit(0))
    advantage = bind(padded(F.col("rewards"), length), lambda r: F.flatten(F.transform("stats", lambda s: F.transform(
        F.slice(r, s["first"] + 1, s["after"] - s["first"]),
        lambda x: (x - s["mean"]) / (s["std"] + STD_OFFSET)))))
    return joined.withColumn("advantages", advantage).drop("stats")


def completion_means(rollouts: DataFrame) -> DataFrame:
    """Mean reward and advantage per completion: the whole sum over the masked count."""
    def total(values: str) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    tokens = F.greatest(F.aggregate("mask", F.lit(0), lambda a, x: a + x), F.lit(1))
    return rollouts.withColumns({
        "mean_reward": total("rewards") / tokens,
        "mean_advantage": total("advantages") / tokens,
    })


def rollout_log(rollouts: DataFrame) -> DataFrame:
    """The logged columns: one row per completion, no per-token values."""
    return completion_means(rollouts).select(
        "batch_id", *COMPLETION, "prompt", "completion", "mean_reward", "mean_advantage")


def reward_stats(rollouts: DataFrame) -> DataFrame:
    """Mean and deviation of all rewards of a batch, padding zeros included; null rewards count as no value.

    A completion's rewards are summed in its row, so no row per token exists. Squares
    are taken around the completion's own mean there, and around zero between
    completions: where all of a batch is equal, rounding leaves some 1e-8 of the mean.
    """
    def summed(values: Column) -> Column:
        n = F.size(values)
        mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.greatest(n, F.lit(1))
        return bind(mean, lambda m: F.struct(n.alias("n"), m.alias("mean"), F.aggregate(
            values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)).alias("m2")))

    known = F.filter(F.coalesce("rewards", F.array().cast("array<double>")), lambda r: r.isNotNull())
    n, mean = F.col("s")["n"], F.col("s")["mean"]
    total = F.sum(n * mean)
    sums = rollouts.select("batch_id", F.size("rewards").alias("len"), bind(known, summed).alias("s")).groupBy(
        "batch_id").agg(
        (F.max("len") * F.count(F.lit(1))).alias("cells"), F.sum(n).alias("n"), F.try_divide(total, F.sum(n)).alias("mean"),
        (F.sum(F.col("s")["m2"]) + F.greatest(
            F.sum(n * mean * mean) - F.coalesce(F.try_divide(total * total, F.sum(n)), F.lit(0.0)), F.lit(0.0))).alias("m2"))
    mean, std = _merge_zeros(F.col("n"), F.col("mean"), F.col("m2"), F.col("cells"))
    return sums.select("batch_id", "cells", mean.alias("token_mean"), std.alias("token_std"))


def zero_std_fraction(rollouts: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Share of a batch's (group, position) cells whose deviation is about zero.

    Positions past a group's longest completion hold only padding: they count
    as zero for groups of several and, having no deviation, not for groups of one.
    """
    flat = F.filter("stats", lambda c: F.abs(c["std"]) <= tolerance)
    groups = group_stats(rollouts).select(
        "batch_id", "size", F.coalesce(F.array_max(F.transform("stats", lambda c: c["after"])), F.lit(0)).alias("len"),
        F.aggregate(flat, F.lit(0), lambda a, c: a + c["after"] - c["first"]).alias("zero"))
    several = F.col("size") > 1
    # summed over groups: zeros inside, and max_len - len past each group of several
    return groups.groupBy("batch_id").agg(
        F.max("len").alias("max_len"), F.count(F.lit(1)).alias("groups"),
        F.sum("zero").alias("inside"), F.count_if(several).alias("several"),
        F.sum(F.when(several, F.col("len")).otherwise(0)).alias("covered"),
    ).select("batch_id", F.try_divide(
        (F.col("inside") + F.col("max_len") * F.col("several") - F.col("covered")).cast("double"),
        F.col("max_len") * F.col("groups")).alias("frac_zero_std"))


def length_stats(lengths: DataFrame, by: list[str]) -> DataFrame:
    """Length statistics from (length, terminated): all, and those that reached their end token."""
    ended = F.when(F.col("terminated"), F.col("length"))
    zero = F.lit(0)
    return lengths.groupBy(*by).agg(
        F.avg("length").alias("mean_length"), F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        (1 - F.count_if("terminated") / F.count(F.lit(1))).alias("clipped_ratio"),
        F.coalesce(F.avg(ended), F.lit(0.0)).alias("mean_terminated_length"),
        F.coalesce(F.min(ended), zero).alias("min_terminated_length"),
        F.coalesce(F.max(ended), zero).alias("max_terminated_length"))
