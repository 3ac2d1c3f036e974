"""Rewards, advantages and loss audit against brute force on small groups."""

import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from stepwright.functions import tokens
from stepwright.operators import loss, rewards
from stepwright.plans import inputs
from stepwright.plans import rewards as plans

SCHEMA = "batch_id bigint, prompt_id bigint, gen int, rewards array<double>, mask array<int>"


def make_rollouts():
    rng = random.Random(7)
    rows = []
    for prompt in range(12):
        gens = 300 if prompt == 0 else rng.choice([1, 2, 4, 4])
        for gen in range(gens):
            n = rng.randint(0, 9)
            values = [rng.choice([0.0, 0.5, -0.25, 0.1]) for _ in range(n)]
            if prompt == 5:
                values = [0.1] * n
            rows.append((prompt // 3, prompt, gen, values, [1] * (n // 2) + [0] * (n - n // 2)))
    return rows


ROWS = make_rollouts()


def grid():
    """(batch, prompt, gen, pos) to reward, padded to the batch's longest."""
    longest = {}
    for b, _, _, r, _ in ROWS:
        longest[b] = max(longest.get(b, 0), len(r))
    return {(b, p, g, i): (r[i] if i < len(r) else 0.0) for b, p, g, r, _ in ROWS for i in range(longest[b])}


def groups():
    out = {}
    for (b, p, g, i), r in grid().items():
        out.setdefault((b, p, i), []).append(r)
    return out


def check_advantages(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    cells, by_group = grid(), groups()
    rows = rewards.group_advantages(df).collect()
    assert len(rows) == len(ROWS)
    totals = {}
    for row in rows:
        for i, a in enumerate(row.advantages):
            group = by_group[row.batch_id, row.prompt_id, i]
            if len(group) == 1:
                assert a is None
                continue
            want = (cells[row.batch_id, row.prompt_id, row.gen, i] - statistics.fmean(group)) / (
                statistics.stdev(group) + 1e-8)
            assert a == pytest.approx(want, abs=1e-6)
            totals[row.prompt_id, i] = totals.get((row.prompt_id, i), 0.0) + a
    assert all(abs(t) < 1e-6 for t in totals.values())


def test_group_advantages(spark):
    check_advantages(spark)


def test_rewards_that_change_at_every_token(spark):
    rng = random.Random(8)
    values = [[rng.uniform(-1, 1) for _ in range(20_000 - 3 * g)] for g in range(4)]
    df = spark.createDataFrame([(0, 0, g, v, []) for g, v in enumerate(values)], SCHEMA)
    started = time.monotonic()
    stats = rewards.group_stats(df).first().stats  # each stretch over all runs would take 10^9 comparisons
    assert time.monotonic() - started < 30
    assert [(s.first, s.after) for s in stats] == [(i, i + 1) for i in range(20_000)]
    for i in (0, 1, 777, 19_990, 19_992, 19_996, 19_999):
        at = [v[i] if i < len(v) else 0.0 for v in values]
        assert stats[i].mean == pytest.approx(statistics.fmean(at))
        assert stats[i].std == pytest.approx(statistics.stdev(at))


def test_runs_and_plan_move_no_token_rows(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.5, 1.5, 0.0],), ([],), ([2.0],)], "rewards array<double>")
    got = [[tuple(r) for r in row.r] for row in df.select(rewards.reward_runs(F.col("rewards")).alias("r")).collect()]
    assert got == [[(0, 2, 0.0), (2, 4, 1.5), (4, 5, 0.0)], [], [(0, 1, 2.0)]]
    plan = rewards.group_advantages(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_dense_rewards_and_stats(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    cells, by_group = grid(), groups()
    for row in rewards.dense_rewards(df).collect():
        assert row.rewards == [cells[row.batch_id, row.prompt_id, row.gen, i] for i in range(row.max_len)]
    stats = {r.batch_id: r for r in rewards.reward_stats(df).collect()}
    shares = {r.batch_id: r.frac_zero_std for r in rewards.zero_std_fraction(df).collect()}
    for b in stats:
        values = [v for key, v in cells.items() if key[0] == b]
        assert stats[b].cells == len(values)
        assert stats[b].token_mean == pytest.approx(statistics.fmean(values))
        assert stats[b].token_std == pytest.approx(statistics.stdev(values))
        zero = [len(g) > 1 and statistics.stdev(g) <= 1e-8 for (gb, _, _), g in by_group.items() if gb == b]
        assert shares[b] == pytest.approx(sum(zero) / len(zero))


def test_completion_means_divide_the_whole_sum_by_the_masked_count(spark):
    df = spark.createDataFrame([(0, 0, 0, [1.0, 2.0, 3.0], [1, 1, 0]), (0, 0, 1, [4.0], [0])], SCHEMA).withColumn(
        "advantages", F.col("rewards"))
    got = {r.gen: r.mean_reward for r in rewards.completion_means(df).collect()}
    assert got == {0: 3.0, 1: 4.0}


def test_spans_later_steps_overwrite_and_missing_ones_do_nothing(spark):
    df = spark.createDataFrame([(
        "Step 1: a b Step 1: a b c".split(), ["Step 1: a b", "b  c", "not there", "a b", " "],
        [0.5, 0.7, 0.9, -1.0, 3.0],
    )], "tokens array<string>, steps array<string>, scores array<double>")
    frame = tokens.framed(F.col("tokens"))
    spans = rewards.step_spans(frame, F.transform("steps", tokens.framed_text), F.col("scores"))
    row = df.select(rewards.token_rewards(tokens.framed_size(frame), spans).alias("r")).first()
    assert row.r == [0.5, 0.5, -1.0, -1.0, 0.0, 0.0, 0.0, 0.7, 0.7]


def test_scores_default_and_repeats(spark):
    steps = spark.createDataFrame([(1, 0, i, f"s{i}") for i in range(3)], "prompt_id int, gen int, step_no int, step string")
    scores = spark.createDataFrame([(1, 0, 0, 0.5), (1, 0, 0, 0.5), (1, 0, 2, -1.0), (9, 0, 0, 1.0)],
                                   "prompt_id int, gen int, step_no int, score double")
    got = {r.step_no: r.score for r in rewards.step_scores(steps, scores).collect()}
    assert got == {0: 0.5, 1: 0.0, 2: -1.0}
    done = spark.createDataFrame([(1, 0, ["a", "b", "c"]), (2, 0, ["a"])], "prompt_id int, gen int, steps array<string>")
    joined = rewards.with_scores(done, scores)
    aligned = joined.select("prompt_id", rewards.aligned_scores(F.col("steps"), F.col("scores")).alias("s"))
    assert {r.prompt_id: r.s for r in aligned.collect()} == {1: [0.5, 0.0, -1.0], 2: [0.0]}


def test_replicate_and_every_nth(spark):
    copies = rewards.replicate(spark.range(3), 4).withColumn("pos", F.col("id") * 4 + F.col("gen"))
    assert copies.count() == 12
    assert sorted(r.id for r in rewards.every_nth(copies, "pos", 4).collect()) == [0, 1, 2]


def test_length_stats_without_terminated_rows(spark):
    df = spark.createDataFrame([(1, 5, False), (1, 3, False), (2, 4, True), (2, 8, False)],
                               "batch_id int, length int, terminated boolean")
    got = {r.batch_id: r for r in rewards.length_stats(df, ["batch_id"]).collect()}
    assert (got[1].mean_length, got[1].clipped_ratio, got[1].mean_terminated_length, got[1].max_terminated_length) == (
        4.0, 1.0, 0.0, 0)
    assert (got[2].clipped_ratio, got[2].min_terminated_length) == (0.5, 4)


TOKENS = ("batch_id bigint, shard bigint, prompt_id bigint, gen int, pos int, mask int, adv double, logp double, "
          "old_logp double, ref_logp double, entropy double")


def make_tokens():
    rng = random.Random(9)
    rows = []
    for prompt in range(10):
        for gen in range(2):
            for pos in range(rng.randint(1, 60 if prompt else 900)):
                rows.append((prompt // 5, prompt % 2, prompt, gen, pos, int(rng.random() < 0.7),
                             rng.uniform(-1, 1), -rng.random(), -rng.random(), -rng.random(), rng.random() * 6))
    return rows


def quantile(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    low = math.floor(at)
    return values[low] + (values[math.ceil(at)] - values[low]) * (at - low)


def test_nan_entropies_don_t_count_and_are_not_marked(spark):
    rows = [(1, i, 1, float(i)) for i in (1, 2, 3, 4)] + [(1, 5, 1, float("nan")), (1, 6, 0, 9.0), (2, 1, 1, float("nan"))]
    tokens = spark.createDataFrame(rows, "batch_id int, place int, mask int, entropy double")
    assert [tuple(r) for r in loss.entropy_thresholds(tokens, 0.75).collect()] == [(1, 3.25)]
    marked = {(r.batch_id, r.place) for r in loss.with_entropy_mask(tokens, 0.25).where("entropy_mask = 1").collect()}
    assert marked == {(1, 4)}


@pytest.mark.parametrize("width", [2.0 ** -10, 1.0, 100.0])
def test_entropy_threshold_is_the_exact_quantile(spark, width):
    rows = make_tokens()
    df = spark.createDataFrame(rows, TOKENS)
    got = {r.batch_id: r.threshold for r in loss.entropy_thresholds(df, 0.8, width).collect()}
    for b in (0, 1):
        want = quantile([r[10] for r in rows if r[0] == b and r[5]], 0.8)
        assert got[b] == pytest.approx(want, abs=1e-12)


def test_entropies_that_crowd_near_zero(spark):
    rng = random.Random(3)
    values = [rng.random() * 2.0 ** -rng.choice([1, 12, 26, 45]) for _ in range(3000)] + [0.0] * 50
    df = spark.createDataFrame([(0, 0, 0, 0, i, 1, 0.0, 0.0, 0.0, 0.0, v) for i, v in enumerate(values)], TOKENS)
    for q in (0.0, 0.013, 0.5, 0.8, 1.0):
        assert loss.entropy_thresholds(df, q).first().threshold == pytest.approx(quantile(values, q), rel=1e-12)


def test_entropy_mask(spark):
    rows = make_tokens()
    df = spark.createDataFrame(rows, TOKENS)
    kept = loss.with_entropy_mask(df, 0.2).agg(F.sum("entropy_mask")).first()[0]
    assert loss.with_entropy_mask(df, 0.2).count() == len(rows)
    want = 0
    for b in (0, 1):
        cut = quantile([r[10] for r in rows if r[0] == b and r[5]], 0.8)
        want += sum(1 for r in rows if r[0] == b and r[5] and r[10] >= cut)
    assert kept == want


def test_batch_loss_and_clip_ratios(spark):
    rows = make_tokens()
    df = spark.createDataFrame(rows, TOKENS)
    p = loss.LossParams(0.1, 0.3, 0.05)
    sums, clips = {}, {}
    for b, shard, prompt, gen, _, mask, adv, lp, old, ref, _ in rows:
        ratio = math.exp(lp - old)
        value = -min(ratio * adv, min(max(ratio, 0.9), 1.3) * adv) + 0.05 * (math.exp(ref - lp) - (ref - lp) - 1)
        total, n = sums.get((b, prompt, gen), (0.0, 0))
        sums[b, prompt, gen] = total + value * mask, n + mask
        low, n = clips.get((b, shard), (0, 0))
        clips[b, shard] = low + mask * (ratio < 0.9 and adv < 0), n + mask
    got = {r.batch_id: r for r in loss.batch_loss(df, p).collect()}
    ratios = {r.batch_id: r for r in loss.clip_ratios(df, p).collect()}
    for b in (0, 1):
        means = [t / max(n, 1) for (sb, _, _), (t, n) in sums.items() if sb == b]
        assert got[b].loss == pytest.approx(statistics.fmean(means))
        lows = [t / max(n, 1) for (sb, _), (t, n) in clips.items() if sb == b]
        assert ratios[b].low_mean == pytest.approx(statistics.fmean(lows))
        assert ratios[b].low_min == pytest.approx(min(lows))


def test_nan_shards_are_skipped(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, float("nan")), (2, 0, float("nan"))],
                               "batch_id int, shard int, v double")
    got = {r.batch_id: (r.mean, r.top) for r in
           loss.across_shards(df, {"mean": ("v", "mean"), "top": ("v", "max")}).collect()}
    assert got == {1: (0.5, 0.5), 2: (None, None)}


def test_token_rows_get_the_reward_of_the_last_span(spark):
    rng = random.Random(4)
    sizes = {(1, 0): 500, (1, 1): 3, (2, 0): 0, (3, 0): 120, (None, 0): 40}
    spans = [(*k, n, a, b, rng.random()) for k, size in sizes.items() for n in range(25)
             for a, b in [sorted((rng.randrange(size + 1), rng.randrange(size + 1)))]]
    spans += [(9, 9, 0, 0, 4, 1.0), (3, 0, 30, 5, 10**6, 0.5)]  # no tokens, and a span that goes past the end
    expected = {(*k, pos): next((s[5] for s in sorted(spans, key=lambda s: -s[2]) if s[:2] == k and None not in k and s[3] <= pos < s[4]), 0.0)
                for k, size in sizes.items() for pos in range(size)}
    tokens = spark.createDataFrame(list(expected), "prompt_id int, gen int, pos int").repartition(5)
    table = spark.createDataFrame(spans, "prompt_id int, gen int, step_no int, first int, after int, score double")
    for block in (1, 7, 4096):
        found = rewards.token_rewards_by_rows(tokens, table, ["prompt_id", "gen"], block).collect()
        assert len(found) == len(expected)
        assert {tuple(r)[:3]: r.reward for r in found} == expected


def test_rows_of_a_join_are_grouped_where_they_are(spark):
    tokens = spark.range(1000).selectExpr("id % 3 AS prompt_id", "id % 2 AS gen", "id AS pos")
    spans = spark.range(1000).selectExpr("id % 3 AS prompt_id", "id % 2 AS gen", "id AS step_no", "id AS first", "id + 3 AS after",
                                         "1.0D AS score")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rewards.token_rewards_by_rows(
            tokens, spans, ["prompt_id", "gen"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2


def test_tokens_are_packed_before_they_move(spark):
    """a row a token in the join made one task's memory grow with all its tokens."""
    tokens = spark.range(64 * 1000, numPartitions=1).selectExpr("1L AS prompt_id", "0 AS gen", "cast(id AS int) AS pos")
    spans = spark.createDataFrame([(1, 0, 0, 100, 200, 1.5), (1, 0, 1, 150, 5000, -0.5), (1, 0, 2, 160, 170, None)],
                                  "prompt_id bigint, gen int, step_no int, first int, after int, score double")
    found = rewards.token_rewards_by_rows(tokens.union(tokens), spans, ["prompt_id", "gen"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan
    rows = {r.pos: r.reward for r in found.collect()}
    assert found.count() == len(rows) == 64000
    assert all(rows[p] == (0.0 if p < 100 or p >= 5000 or 160 <= p < 170 else 1.5 if p < 150 else -0.5) for p in rows)


def test_audits_share_one_pass_over_the_tokens(spark, sf_dir):
    """the rewards were computed twice for the audits, and the token signals three times."""
    plan = plans.audit_metric_points(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1  # lengths; the others read what was written
    signals = inputs.token_signals(spark, sf_dir)
    means = loss.shard_means(signals)
    for audit in (loss.kl_stats, loss.entropy_stats, loss.clip_ratios):
        whole = {r.batch_id: [round(x, 9) for x in r[1:]] for r in audit(signals).collect()}
        assert whole == {r.batch_id: [round(x, 9) for x in r[1:]] for r in audit(means).collect()}
