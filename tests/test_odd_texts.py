"""Text-heavy queries against their SQL on a table of awkward texts with a hot language."""

import random
import shutil

import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck
from tests.conftest import SMALL

BITS = [
    "word ", "Step 1: ", "Step 2: ", "Step 3:", "Step 10: ", "\n", "\n\n", "\n" * 5, "\n" * 7, chr(0x3000), chr(0xA0),
    "\t", " \x1c ", "<answer>Yes</answer>", "<answer>", "</explanation>", "<b>", "&amp;", "&lt;", "&quot;",
    "{question}", "{preference}", "{end_generation}", "**SCORE:** 3", "**score:**-.5", "<eos>", " <eos> ", "the ",
    "de ", chr(0x1F600), "é", '"', "\\", "'", "$1", "<|im_start|>assistant\n", "<img>", "<pad>", "Yes", "no", "  ",
    "Final Answer Node.", "a", chr(0x2028), "日本 語"]
QUERIES = [
    "accuracy_report", "render_judge_prompt", "judge_request_batch", "reply_ingest", "parse_verdict",
    "hallucination_prompt_join", "thought_tree_paths", "dfs_order", "append_final_score", "split_steps",
    "critique_messages", "loss_span", "cap_responses", "explode_responses", "seeded_split",
    "token_length_profile", "parse_score", "split_completion_steps", "tail_truncate", "strip_repeat_tokens",
    "mask_truncated", "find_subsequence", "step_scores_default", "token_span_reward", "group_advantage",
    "high_entropy_mask", "scan_json_array_dir", "scan_jsonl_tolerant", "quarantine_corrupt", "sink_by_source_file",
    "incremental_verdicts", "transcript"]


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd") / "sf"
    shutil.copytree(SMALL, folder, copy_function=shutil.copyfile)
    folder.chmod(0o755)
    rng = random.Random(1)
    texts = ["x", "ab", " ", "\n", "\n\n", " a ", "é", chr(0x1F600) * 2, "Step 1: a", "<eos>", "word"]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    documents = [(i, t, "en" if i % 3 == 0 else rng.choice(["de", "fr", "es"]), f"src{rng.randint(0, 19)}", len(t))
                 for i, t in enumerate(texts)]
    turns = [(0 if i % 3 == 0 else i % 9, i, rng.choice(["user", "assistant", "system", "éx"]), rng.choice(texts))
             for i in range(300)]
    pd.DataFrame(documents, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(
        folder / "documents.parquet", index=False)
    pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).to_parquet(
        folder / "conversations.parquet", index=False)
    return str(folder)


@pytest.fixture(scope="module")
def con(odd_dir):
    return duck(odd_dir)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, con, odd_dir, name):
    assert difference(entry.queries()[name](spark, odd_dir), con, entry.oracle_sql()[name]) is None
