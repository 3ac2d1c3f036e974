"""Registered queries: completions, token rewards, advantages, loss audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.functions import prompts, tokens as tok
from stepwright.functions.arrays import as_rows
from stepwright.functions.steps import with_completion_steps
from stepwright.functions.text import collapse_tokens, parse_score as score_of, words
from stepwright.operators import loss, metrics, rewards
from stepwright.plans import inputs, jobs
from stepwright.plans import oracle_inputs as sql
from stepwright.plans.inputs import EOS
from stepwright.sources.workspace import new_path, written

KEYS = ["prompt_id", "gen"]
PROMPT_TOKENS = 2048   # fixed value: prompt budget
COMPLETION_TOKENS = 1024   # fixed value: completion budget
GENERATIONS = 4   # fixed value: completions per prompt
TOP_ENTROPY = 0.2


def r6(column: Column, name: str) -> Column:
    return F.round(column, 6).alias(name)


def completion_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.completions(spark, sf).withColumn("tokens", words(F.col("completion")))


def parse_score(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.critique_replies(spark, sf).select(*KEYS, "step_no", score_of(F.col("raw")).alias("score"))


def split_completion_steps(spark: SparkSession, sf: str) -> DataFrame:
    split = with_completion_steps(inputs.completions(spark, sf), "completion")
    return split.select(*KEYS, F.posexplode(as_rows(F.col("steps"))).alias("step_no", "step"))


def tail_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as prompts: the last 2048 tokens, and 256 that keep a protected word."""
    tokens = words(F.col("text"))
    return inputs.documents(spark, sf).withColumn("tokens", tokens).select(
        "doc_id", F.array_join(tok.tail(F.col("tokens"), PROMPT_TOKENS), " ").alias("tail"),
        F.array_join(tok.tail(F.col("tokens"), 256, ["the", "de"]), " ").alias("protected"))


def strip_repeat_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Padded texts with runs of image tokens, put back to their template form."""
    padded = F.concat(F.repeat(F.lit("<pad>"), (F.col("doc_id") % 4).cast("int")),
                      F.regexp_replace("text", " ", "<img><img><img>"), F.lit("<pad>"))
    return inputs.documents(spark, sf).select(
        "doc_id", collapse_tokens(padded, "<pad>", "<img>").alias("text"))


def eos_mask(spark: SparkSession, sf: str) -> DataFrame:
    rows = completion_tokens(spark, sf)
    return rows.select(*KEYS, F.array_join(tok.eos_mask(F.col("tokens"), F.lit(EOS)), "").alias("mask"))


def mask_truncated(spark: SparkSession, sf: str) -> DataFrame:
    mask = tok.mask_truncated(tok.eos_mask(F.col("tokens"), F.lit(EOS)), F.col("tokens"), F.lit(EOS))
    return completion_tokens(spark, sf).select(*KEYS, F.array_join(mask, "").alias("mask"))


def find_subsequence(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every step's tokens in its completion's tokens."""
    split = with_completion_steps(inputs.completions(spark, sf), "completion").withColumn(
        "frame", tok.framed_text(F.col("completion")))
    return split.select(*KEYS, F.posexplode(F.transform("steps", lambda s: tok.find_framed(
        F.col("frame"), tok.framed_text(s)))).alias("step_no", "first"))


def replicate_generations(spark: SparkSession, sf: str) -> DataFrame:
    asked = inputs.documents(spark, sf).select("doc_id", inputs.first_line().alias("prompt"))
    copies = rewards.replicate(asked, GENERATIONS).withColumn("position", F.col("doc_id") * GENERATIONS + F.col("gen"))
    return copies.withColumn("is_first", rewards.is_nth("position", GENERATIONS).cast("int"))


def step_scores_default(spark: SparkSession, sf: str) -> DataFrame:
    scored = rewards.step_scores(
        split_completion_steps(spark, sf), parse_score(spark, sf))
    return scored.select(*KEYS, "step_no", "step", "score")


def completion_avg_score(spark: SparkSession, sf: str) -> DataFrame:
    """Mean step score per completion; scores and steps meet per completion."""
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return inputs.scored_completions(spark, sf).select(
        *KEYS, r6(F.coalesce(F.try_divide(total, F.size("scores")), F.lit(0.0)), "avg_score"))


def token_span_reward(spark: SparkSession, sf: str) -> DataFrame:
    """Every token's reward, in order, in tenths."""
    tenths = F.transform("rewards", lambda r: F.round(r * 10).cast("bigint").cast("string"))
    return inputs.rewarded(spark, sf).select(*KEYS, F.array_join(tenths, ",").alias("rewards"))


def token_span_reward_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same for tokens that are rows: a range join of tokens and spans."""
    completions = inputs.completions(spark, sf)
    tokens = completions.select(*KEYS, F.posexplode(words(F.col("completion"))).alias("pos", "token")).drop("token")
    spans = rewards.span_rows(completions, parse_score(spark, sf))
    return rewards.token_rewards_by_rows(tokens, spans, KEYS).select(
        *KEYS, "pos", F.round(F.col("reward") * 10).cast("bigint").alias("tenths"))


def dense_token_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Per completion: the padded length and a position-weighted sum over the grid."""
    dense = rewards.dense_rewards(inputs.rollouts(spark, sf))
    weighted = F.aggregate(F.transform("rewards", lambda r, i: r * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return dense.select("batch_id", *KEYS, F.size("rewards").alias("cells"), r6(weighted, "weighted"))


def _advantages(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return rewards.group_advantages(inputs.rollouts(spark, sf, *columns))


def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    """The advantage of every token."""
    rows = _advantages(spark, sf).select("batch_id", *KEYS, F.posexplode("advantages").alias("pos", "advantage"))
    return rows.withColumn("advantage", F.round("advantage", 6) + F.lit(0.0))  # no negative zero


def completion_mean_reward(spark: SparkSession, sf: str) -> DataFrame:
    return rewards.completion_means(_advantages(spark, sf, "mask")).select(
        *KEYS, r6(F.col("mean_reward"), "mean_reward"), r6(F.col("mean_advantage"), "mean_advantage"))


def rollout_log(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "rollouts")
    log = rewards.rollout_log(_advantages(spark, sf, "mask", "prompt", "completion")).withColumn("step", F.floor(F.col("batch_id") / 8))
    log.hint("rebalance", "step").write.partitionBy("step").parquet(path)
    return spark.read.parquet(path).select(
        F.col("step").cast("bigint").alias("step"), "batch_id", *KEYS, "prompt", "completion",
        r6(F.col("mean_reward"), "mean_reward"), r6(F.col("mean_advantage"), "mean_advantage"))


def reward_stats(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    rows = inputs.rewarded(spark, sf) if rows is None else rows
    stats = rewards.reward_stats(rows.select("batch_id", "rewards"))
    return stats.select("batch_id", "cells", r6(F.col("token_mean"), "token_mean"), r6(F.col("token_std"), "token_std"))


def zero_std_fraction(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    rows = inputs.rewarded(spark, sf) if rows is None else rows
    shares = rewards.zero_std_fraction(rows.select("batch_id", "prompt_id", "rewards"))
    return shares.select("batch_id", r6(F.col("frac_zero_std"), "frac_zero_std"))


def completion_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    lengths = completion_tokens(spark, sf).select(
        "batch_id", tok.eos_length(F.col("tokens"), F.lit(EOS)).alias("length"),
        F.array_contains("tokens", EOS).alias("terminated"))
    stats = rewards.length_stats(lengths, ["batch_id"])
    return stats.select("batch_id", *[r6(F.col(c), c) if t == "double" else F.col(c)
                                      for c, t in stats.dtypes if c != "batch_id"])


def policy_loss_audit(spark: SparkSession, sf: str) -> DataFrame:
    audit = loss.batch_loss(inputs.token_signals(spark, sf))
    return audit.select("batch_id", "sequences", r6(F.col("loss"), "loss"))


def kl_stats(spark: SparkSession, sf: str, means: DataFrame | None = None) -> DataFrame:
    return loss.kl_stats(inputs.token_signals(spark, sf) if means is None else means).select("batch_id", r6(F.col("kl"), "kl"))


def entropy_stats(spark: SparkSession, sf: str, means: DataFrame | None = None) -> DataFrame:
    return loss.entropy_stats(inputs.token_signals(spark, sf) if means is None else means).select("batch_id", r6(F.col("entropy"), "entropy"))


def clip_ratios(spark: SparkSession, sf: str, means: DataFrame | None = None) -> DataFrame:
    ratios = loss.clip_ratios(inputs.token_signals(spark, sf) if means is None else means)
    return ratios.select("batch_id", *[r6(F.col(c), c) for c in ratios.columns if c != "batch_id"])


def high_entropy_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Per batch: the entropy threshold, tokens kept, and the loss over kept tokens."""
    marked = loss.with_entropy_mask(inputs.token_signals(spark, sf), TOP_ENTROPY)
    kept = marked.groupBy("batch_id").agg(
        F.max("threshold").alias("threshold"), F.sum("entropy_mask").alias("kept"),
        F.sum("mask").alias("tokens"),
        F.sum(loss.token_loss(loss.LossParams(), F.col("entropy_mask")) * F.col("mask")).alias("loss_sum"))
    return kept.select("batch_id", r6(F.col("threshold"), "threshold"), "kept", "tokens", r6(F.col("loss_sum"), "loss_sum"))


def entropy_masked_loss(spark: SparkSession, sf: str) -> DataFrame:
    """The loss of each batch where only tokens of high entropy drive the policy."""
    marked = loss.with_entropy_mask(inputs.token_signals(spark, sf), TOP_ENTROPY)
    return loss.batch_loss(marked, entropy_mask=F.col("entropy_mask")).select(
        "batch_id", "sequences", r6(F.col("loss"), "loss"))


def critique_requests(spark: SparkSession, sf: str) -> DataFrame:
    """What the critique model is asked about every step of every completion."""
    asked = jobs.critique_requests(inputs.completions(spark, sf))
    body = F.from_json("body", "model string, prompt string, max_tokens int, temperature double, stop array<string>")
    return asked.withColumn("b", body).select(
        *KEYS, "step_no", "b.model", "b.prompt", "b.max_tokens", "b.temperature", F.col("b.stop")[0].alias("stop"))


def scored_rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """Completions and critique replies to the logged rows, by the job."""
    log = jobs.score_rollouts(inputs.completions(spark, sf), inputs.critique_replies(spark, sf), EOS)
    return log.select("batch_id", *KEYS, "prompt", "completion", r6(F.col("mean_reward"), "mean_reward"),
                      r6(F.col("mean_advantage"), "mean_advantage"))


def audit_metric_points(spark: SparkSession, sf: str) -> DataFrame:
    """All audits of a run as logged metric points, rolled up by interval; every fifth batch is an evaluation."""
    # rewards and token signals are computed once, for all audits that read them
    rows = written(inputs.rewarded(spark, sf).select("batch_id", "prompt_id", "rewards"), "rewards")
    means = written(loss.shard_means(inputs.token_signals(spark, sf)), "shard-means")
    points = metrics.audit_points([
        completion_length_stats(spark, sf), reward_stats(spark, sf, rows), zero_std_fraction(spark, sf, rows),
        *[f(spark, sf, means) for f in (kl_stats, entropy_stats, clip_ratios)]])
    modes = points.withColumn("mode", F.when(F.col("step") % 5 == 0, "eval").otherwise("train"))
    rolled = metrics.metric_rollup(modes)
    return rolled.select("mode", "interval", "metric", F.round("value", 5).alias("value"), "points")


QUERIES = {f.__name__: f for f in (
    entropy_masked_loss, critique_requests, scored_rollouts, audit_metric_points, parse_score, split_completion_steps, tail_truncate, strip_repeat_tokens, eos_mask, mask_truncated,
    find_subsequence, replicate_generations, step_scores_default, completion_avg_score, token_span_reward,
    token_span_reward_rows, dense_token_grid, group_advantage, completion_mean_reward, rollout_log, reward_stats, zero_std_fraction,
    completion_length_stats, policy_loss_audit, kl_stats, entropy_stats, clip_ratios, high_entropy_mask)}

MASK_SQL = """array_to_string(list_transform(range(len(tokens)), lambda i:
    CASE WHEN coalesce(list_position(tokens, '<eos>'), 0) = 0 OR i < list_position(tokens, '<eos>')
    THEN 1 ELSE 0 END), '')"""
MEANS = """means AS (
  SELECT a.prompt_id, a.gen, round(sum(a.reward) / greatest(coalesce(sum(r.mask), 0), 1), 6) AS mean_reward,
    round(sum(a.adv) / greatest(coalesce(sum(r.mask), 0), 1), 6) AS mean_advantage
  FROM advantages a LEFT JOIN rewards r ON r.prompt_id = a.prompt_id AND r.gen = a.gen AND r.pos = a.pos
  GROUP BY a.prompt_id, a.gen)"""
LOSS = "(-least(ratio * adv, least(greatest(ratio, 0.8::DOUBLE), 1.2::DOUBLE) * adv))"
PER_SHARD = "sum({0} * mask) / greatest(sum(mask), 1)"
LENGTH = "CASE WHEN terminated THEN length END"

ORACLES = {
    "parse_score": f"WITH {sql.CRITIQUES} SELECT prompt_id, gen, step_no, score FROM scores",
    "split_completion_steps": f"""WITH {sql.COMPLETION_STEPS}
        SELECT prompt_id, gen, generate_subscripts(steps, 1) - 1 AS step_no, unnest(steps) AS step FROM csteps""",
    "tail_truncate": f"""WITH w AS (SELECT doc_id, {sql.words('text')} AS t FROM documents),
        u AS (SELECT doc_id, t, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM w),
        m AS (SELECT *, tok IN ('the', 'de') AS shield FROM u),
        f AS (SELECT *, count(*) FILTER (shield) OVER (PARTITION BY doc_id) AS shields,
          count(*) FILTER (NOT shield) OVER (PARTITION BY doc_id ORDER BY i DESC) AS from_end FROM m),
        k AS (SELECT doc_id, string_agg(tok, ' ' ORDER BY i) FILTER (shield OR from_end <= greatest(256 - shields, 0))
          AS kept FROM f GROUP BY doc_id)
        SELECT w.doc_id, array_to_string(t[greatest(len(t) - {PROMPT_TOKENS}, 0) + 1:], ' ') AS tail,
          coalesce(kept, '') AS protected FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
    "strip_repeat_tokens": """SELECT doc_id, regexp_replace(regexp_replace(
          repeat('<pad>', doc_id % 4) || replace(text, ' ', '<img><img><img>') || '<pad>', '^(<pad>)+', ''),
          '(<img>)+', '<img>', 'g') AS text FROM documents""",
    "eos_mask": f"WITH {sql.COMPLETION_STEPS} SELECT prompt_id, gen, {MASK_SQL} AS mask FROM csteps",
    "mask_truncated": f"""WITH {sql.COMPLETION_STEPS}
        SELECT prompt_id, gen, CASE WHEN list_contains(tokens, '{EOS}') THEN {MASK_SQL}
          ELSE repeat('0', len(tokens)) END AS mask FROM csteps""",
    "find_subsequence": f"""WITH {sql.REWARDS} SELECT prompt_id, gen, step_no, first FROM spans""",
    "replicate_generations": f"""SELECT doc_id, {sql.FIRST_LINE} AS prompt, g.gen, doc_id * 4 + g.gen AS position,
        (g.gen = 0)::INTEGER AS is_first FROM documents, (VALUES (0), (1), (2), (3)) g(gen)""",
    "step_scores_default": f"WITH {sql.SCORED} SELECT prompt_id, gen, step_no, step, score FROM scored",
    "completion_avg_score": f"""WITH {sql.SCORED}
        SELECT prompt_id, gen, round(avg(score), 6) AS avg_score FROM scored GROUP BY prompt_id, gen""",
    "token_span_reward": f"""WITH {sql.REWARDS}
        SELECT prompt_id, gen, string_agg(round(reward * 10)::BIGINT::VARCHAR, ',' ORDER BY pos) AS rewards
        FROM rewards GROUP BY prompt_id, gen""",
    "token_span_reward_rows": f"""WITH {sql.REWARDS}
        SELECT prompt_id, gen, pos, round(reward * 10)::BIGINT AS tenths FROM rewards""",
    "dense_token_grid": f"""WITH {sql.GRID}
        SELECT batch_id, prompt_id, gen, count(*) AS cells, round(sum(reward * (pos + 1)), 6) AS weighted
        FROM grid GROUP BY ALL""",
    "group_advantage": f"""WITH {sql.GRID}
        SELECT batch_id, prompt_id, gen, pos, round(adv, 6) + 0.0::DOUBLE AS advantage
        FROM advantages WHERE pos < (SELECT max(len(tokens)) FROM csteps c WHERE c.prompt_id = advantages.prompt_id)""",
    "completion_mean_reward": f"WITH {sql.GRID}, {MEANS} SELECT * FROM means",
    "rollout_log": f"""WITH {sql.GRID}, {MEANS}
        SELECT c.batch_id // 8 AS step, c.batch_id, c.prompt_id, c.gen, c.prompt, c.completion, m.mean_reward,
          m.mean_advantage FROM completions c JOIN means m ON m.prompt_id = c.prompt_id AND m.gen = c.gen""",
    "reward_stats": f"""WITH {sql.GRID}
        SELECT batch_id, count(*) AS cells, round(avg(reward), 6) AS token_mean,
          round(stddev_samp(reward), 6) AS token_std FROM grid GROUP BY batch_id""",
    "zero_std_fraction": f"""WITH {sql.GRID}, g AS (
          SELECT batch_id, prompt_id, pos, stddev_samp(reward) AS std FROM grid GROUP BY ALL)
        SELECT batch_id, round(avg(CASE WHEN abs(std) <= 1e-8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS frac_zero_std
        FROM g GROUP BY batch_id""",
    "completion_length_stats": f"""WITH {sql.COMPLETION_STEPS}, l AS (
          SELECT batch_id, list_contains(tokens, '{EOS}') AS terminated,
            CASE WHEN list_contains(tokens, '{EOS}') THEN list_position(tokens, '{EOS}') ELSE len(tokens) END AS length
          FROM csteps)
        SELECT batch_id, round(avg(length), 6) AS mean_length, min(length) AS min_length, max(length) AS max_length,
          round(1 - count(*) FILTER (terminated)::DOUBLE / count(*), 6) AS clipped_ratio,
          round(coalesce(avg({LENGTH}), 0), 6) AS mean_terminated_length,
          coalesce(min({LENGTH}), 0) AS min_terminated_length, coalesce(max({LENGTH}), 0) AS max_terminated_length
        FROM l GROUP BY batch_id""",
    "policy_loss_audit": f"""WITH {sql.SIGNALS}, s AS (
          SELECT batch_id, prompt_id, gen, {PER_SHARD.format(f'({LOSS} + 0.05::DOUBLE * kl)')} AS loss
          FROM priced GROUP BY ALL)
        SELECT batch_id, count(*) AS sequences, round(avg(loss), 6) AS loss FROM s GROUP BY batch_id""",
    "kl_stats": f"""WITH {sql.SIGNALS}, s AS (
          SELECT batch_id, shard, {PER_SHARD.format('kl')} AS v FROM priced GROUP BY ALL)
        SELECT batch_id, round(avg(v), 6) AS kl FROM s GROUP BY batch_id""",
    "entropy_stats": f"""WITH {sql.SIGNALS}, s AS (
          SELECT batch_id, shard, {PER_SHARD.format('entropy')} AS v FROM priced GROUP BY ALL)
        SELECT batch_id, round(avg(v), 6) AS entropy FROM s GROUP BY batch_id""",
    "clip_ratios": f"""WITH {sql.SIGNALS}, f AS (
          SELECT *, (ratio < 0.8::DOUBLE AND adv < 0)::INTEGER AS lo, (ratio > 1.2::DOUBLE AND adv > 0)::INTEGER AS hi
          FROM priced),
        s AS (SELECT batch_id, shard, {PER_SHARD.format('lo')} AS lo, {PER_SHARD.format('hi')} AS hi,
          {PER_SHARD.format('greatest(lo, hi)')} AS either FROM f GROUP BY batch_id, shard)
        SELECT batch_id, round(avg(lo), 6) AS low_mean, round(min(lo), 6) AS low_min, round(avg(hi), 6) AS high_mean,
          round(max(hi), 6) AS high_max, round(avg(either), 6) AS region_mean FROM s GROUP BY batch_id""",
    "high_entropy_mask": f"""WITH {sql.SIGNALS}, q AS (
          SELECT batch_id, quantile_cont(entropy, 1 - {TOP_ENTROPY}::DOUBLE) AS threshold
          FROM priced WHERE mask = 1 GROUP BY batch_id),
        k AS (SELECT p.*, q.threshold, (mask = 1 AND entropy >= q.threshold)::INTEGER AS keep
          FROM priced p JOIN q ON q.batch_id = p.batch_id)
        SELECT batch_id, round(max(threshold), 6) AS threshold, sum(keep)::BIGINT AS kept, sum(mask)::BIGINT AS tokens,
          round(sum(({LOSS} * keep + 0.05::DOUBLE * kl) * mask), 6) AS loss_sum FROM k GROUP BY batch_id""",
}

_INSTRUCTION = sql.lit(prompts.CRITIQUE_INSTRUCTION + "\n\n")
ORACLES["entropy_masked_loss"] = f"""WITH {sql.SIGNALS}, q AS (
      SELECT batch_id, quantile_cont(entropy, 1 - {TOP_ENTROPY}::DOUBLE) AS threshold
      FROM priced WHERE mask = 1 GROUP BY batch_id),
    s AS (SELECT p.batch_id, prompt_id, gen, {PER_SHARD.format(
        f'({LOSS} * (mask = 1 AND entropy >= threshold)::INTEGER + 0.05::DOUBLE * kl)')} AS loss
      FROM priced p JOIN q ON q.batch_id = p.batch_id GROUP BY ALL)
    SELECT batch_id, count(*) AS sequences, round(avg(loss), 6) AS loss FROM s GROUP BY batch_id"""
ORACLES["critique_requests"] = f"""WITH {sql.COMPLETION_STEPS}, n AS (
      SELECT c.prompt_id, c.gen, s.prompt, c.steps, unnest(range(len(c.steps))) AS step_no
      FROM csteps c JOIN completions s ON s.prompt_id = c.prompt_id AND s.gen = c.gen)
    SELECT prompt_id, gen, step_no, 'reward_model' AS model, '<|im_start|>user' || chr(10) || {_INSTRUCTION} || prompt ||
      array_to_string(list_transform(steps[:step_no], lambda x: x || chr(10)), '') || steps[step_no + 1] ||
      '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
      1024 AS max_tokens, 0.0::DOUBLE AS temperature, '<|im_end|>' AS stop FROM n"""
ORACLES["scored_rollouts"] = f"""WITH {sql.GRID}, {MEANS}
    SELECT c.batch_id, c.prompt_id, c.gen, c.prompt, c.completion, m.mean_reward, m.mean_advantage
    FROM completions c JOIN means m ON m.prompt_id = c.prompt_id AND m.gen = c.gen"""
ORACLES["audit_metric_points"] = "WITH points AS (" + " UNION ALL ".join(
    f"SELECT batch_id AS step, '{logged}' AS metric, {column}::DOUBLE AS value FROM ({ORACLES[query]})"
    for query, names in {
        "completion_length_stats": {f"{a}_{b}": f"completions/{a}_{b}" for a in ("mean", "min", "max") for b in (
            "length", "terminated_length")} | {"clipped_ratio": "completions/clipped_ratio"},
        "reward_stats": {"token_mean": "reward/token_mean", "token_std": "reward/token_std"},
        "zero_std_fraction": {"frac_zero_std": "reward/frac_zero_std"}, "kl_stats": {"kl": "kl"},
        "entropy_stats": {"entropy": "entropy"},
        "clip_ratios": {n: f"clip_ratio/{n}" for n in ("low_mean", "low_min", "high_mean", "high_max", "region_mean")},
    }.items() for column, logged in names.items()) + """)
    SELECT CASE WHEN step % 5 = 0 THEN 'eval' ELSE 'train' END AS mode, step // 8 AS interval,
      CASE WHEN step % 5 = 0 THEN 'eval_' || metric ELSE metric END AS metric, round(avg(value), 5) AS value,
      count(value) AS points FROM points GROUP BY ALL"""
