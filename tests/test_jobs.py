"""The file-to-file jobs chained on small golden files."""

import json

from pyspark.sql import functions as F

from stepwright.functions.prompts import METRICS
from stepwright.functions.text import STEP_SEPARATOR as SEP
from stepwright.plans import jobs
from stepwright.sources import schemas
from tests.test_files import TREES


def test_corpus_chain(spark, tmp_path):
    folder = tmp_path / "trees"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(TREES))
    (folder / "bad.json").write_text("[{")
    jobs.enumerate_paths(spark, str(folder), str(tmp_path / "paths"))
    jobs.clean_processes(spark, str(tmp_path / "paths"), str(tmp_path / "clean"))
    rows = [json.loads(line) for f in (tmp_path / "clean").glob("part-*") for line in f.read_text().splitlines()]
    assert sorted((r["idx"], r["process"], r["final_score"]) for r in rows) == [
        (1, "Step 1: a", 1), (1, "Step 1: b", 0.25), (3, "Step 1: c", 0.0)]
    raw = [json.loads(line, parse_int=str, parse_float=str) for f in (tmp_path / "paths").glob("part-*")
           for line in f.read_text().splitlines()]
    assert sorted(r["final_score"] for r in raw) == ["0.0", "0.25", "1"]
    chats = jobs.critique_examples(spark.read.schema(schemas.PROCESS).json(str(tmp_path / "clean")))
    contents = sorted(r.messages[0].content for r in chats.collect())
    assert len(contents) == 3 and contents[0].endswith("Step 1: a" + SEP)


def test_response_chain(spark, tmp_path):
    folder = tmp_path / "responses"
    folder.mkdir()
    item = {"user_profile": "u", "initial_question": "q", "response_list": [
        {"response": [f"Step {i}: x{i}" for i in range(1, 8)], "answer": "old", "score": 0.5}]}
    for name in ("a.json", "b.json"):
        (folder / name).write_text(json.dumps([{**item, "initial_question": f"q{i}"} for i in range(11)]))
    jobs.cap_response_files(spark, str(folder), str(tmp_path / "capped"))
    capped = spark.read.schema(schemas.RESPONSES + ", source_file string").json(str(tmp_path / "capped"))
    assert {(r.source_file, r.response_list[0].answer, len(r.response_list[0].response)) for r in capped.collect()} == {
        ("a.json", "x5", 5), ("b.json", "x5", 5)}
    jobs.split_files(spark, str(folder), str(tmp_path / "split"), schemas.RESPONSES)
    split = spark.read.schema(schemas.RESPONSES + ", split string, source_file string").json(str(tmp_path / "split"))
    train = {f: {r.initial_question for r in split.collect() if r.split == "train" and r.source_file == f}
             for f in ("a.json", "b.json")}
    assert split.count() == 22 and len(train["a.json"]) == 9 and train["a.json"] == train["b.json"]
    jobs.policy_examples(spark, str(folder), str(tmp_path / "sft"))
    assert spark.read.json(str(tmp_path / "sft")).count() == 22


def test_judge_rounds_end_with_nothing_to_ask(spark):
    items = spark.createDataFrame([(1, "p1", "q1", "r1", "x"), (2, "p2", "q2", None, "x")],
                                  "item_id bigint, preference string, question string, response_to_q string, model string")
    none = spark.createDataFrame([], "item_id bigint, metric string, answer string, extract_pref string")
    first = jobs.judge_requests(items, none)
    assert {r.metric for r in first.collect()} == set(METRICS) - {"hallucinate"}
    verdicts = first.select("item_id", "metric", F.lit("Yes").alias("answer"), F.lit("quoted").alias("extract_pref"))
    second = jobs.judge_requests(items, verdicts).collect()
    assert [r.metric for r in second] == ["hallucinate"] and 'Restatement: "quoted"' in second[0].prompt
    done = verdicts.unionByName(spark.createDataFrame([(1, "hallucinate", "No", None)], none.schema))
    assert jobs.judge_requests(items, done).count() == 0
    report = {r.model: r for r in jobs.accuracy(items, done, ["model"]).collect()}
    assert (report["x"].total, report["x"].error_inconsistent, report["x"].quality_aware_pct) == (2, 1, 50.0)
    assert jobs.accuracy(items, done).first().total == 2


def test_rollout_chain(spark):
    done = spark.createDataFrame([
        (0, 7, 0, "ask ", "Step 1: a b Step 2: c"), (0, 7, 1, "ask ", "no marker here"), (0, 8, 0, "other ", "")],
        "batch_id bigint, prompt_id bigint, gen int, prompt string, completion string")
    asked = {(r.prompt_id, r.gen, r.step_no): json.loads(r.body) for r in jobs.critique_requests(done, "m").collect()}
    assert set(asked) == {(7, 0, 0), (7, 0, 1), (7, 1, 0), (8, 0, 0)}
    second = asked[7, 0, 1]["prompt"]
    assert second.endswith("ask Step 1: a b\nStep 2: c<|im_end|>\n<|im_start|>assistant\n")
    assert asked[7, 0, 0]["stop"] == ["<|im_end|>"] and asked[7, 0, 0]["model"] == "m"
    replies = spark.createDataFrame([(7, 0, 0, "good **SCORE:** 1"), (7, 0, 1, "none"), (7, 1, 0, "**score:** -.5")],
                                    "prompt_id bigint, gen int, step_no int, raw string")
    log = {(r.prompt_id, r.gen): r for r in jobs.score_rollouts(done, replies, "<eos>").collect()}
    # Step 1: a b -> four tokens of 1.0, then three of 0.0; no marker here -> three of -0.5
    assert abs(log[7, 0].mean_reward - 4 / 7) < 1e-9 and abs(log[7, 1].mean_reward + 0.5) < 1e-9
    assert log[8, 0].mean_reward == 0.0 and log[7, 0].mean_advantage > 0 > log[7, 1].mean_advantage
