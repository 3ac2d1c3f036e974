"""Physical plans: pruned scans, no cross joins, no Python in the row path, narrow stages stay narrow."""

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

QUERIES = entry.queries()
# built without running a job first
LAZY = [
    "accuracy_report", "error_taxonomy", "eval_by_config", "pending_evaluations", "items_x_rubrics",
    "render_judge_prompt", "reply_ingest", "parse_verdict", "hallucination_prompt_join", "coverage_check",
    "thought_tree_paths", "tree_edge_join", "dangling_children", "append_final_score", "critique_messages",
    "prefix_context_explode", "explode_responses", "best_response", "token_length_profile", "parse_score",
    "split_completion_steps", "tail_truncate", "eos_mask", "find_subsequence", "replicate_generations",
    "step_scores_default", "token_span_reward", "reward_stats", "zero_std_fraction", "policy_loss_audit",
    "kl_stats", "clip_ratios", "metric_rollup", "tokens_seen", "transcript", "union_sources",
]
NARROW = ["thought_tree_paths", "append_final_score", "critique_messages", "prefix_context_explode",
          "explode_responses", "split_completion_steps", "find_subsequence", "transcript", "parse_verdict"]


def plan_of(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def columns_read(plan):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*)>", plan)]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan


@pytest.mark.parametrize("name", NARROW)
def test_row_work_stays_in_the_scan_stage(spark, name):
    # the one exchange spreads the single-split test table over the cores
    exchanges = re.findall(r"Exchange .*", plan_of(spark, name))
    assert all("REPARTITION_BY_NUM" in e for e in exchanges) and len(exchanges) <= 1


def test_expensive_columns_are_not_computed_twice(spark):
    for name in ("split_completion_steps", "find_subsequence", "token_span_reward"):
        assert plan_of(spark, name).count("(?=Step [0-9]+:)") == 1


@pytest.mark.parametrize("name", ["pending_evaluations", "coverage_check"])
def test_keys_only_queries_read_no_text(spark, name):
    read = columns_read(plan_of(spark, name))
    assert read and all("text" not in columns for columns in read)


def test_unused_parts_of_verdicts_are_pruned(spark):
    assert "<explanation" not in plan_of(spark, "accuracy_report").replace("concat(<", "")
    assert all(columns <= {"doc_id", "source", "text"} for columns in columns_read(plan_of(spark, "accuracy_report")))


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("accuracy_report", "policy_loss_audit", "reward_stats", "clip_ratios"):
        assert "partial_" in plan_of(spark, name)


def test_reward_stats_makes_no_row_per_token(spark):
    plan = plan_of(spark, "reward_stats")
    assert not re.search(r"Generate posexplode|Generate explode\(rewards", plan) and "partial_" in plan
