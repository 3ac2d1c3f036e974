"""Taxonomy rules, resume logic and reports."""

import itertools
import json

from pyspark.sql import functions as F

from stepwright.functions.prompts import METRICS, RUBRICS
from stepwright.operators import judge
from stepwright.sources import exchange, rubrics

VERDICT = "item_id bigint, metric string, answer string"


def test_rubrics_name_the_slots_their_metric_fills():
    for metric, template in RUBRICS.items():
        assert ("{preference}" in template) == (metric not in ("acknow", "helpful"))
        assert ("{assistant_restatement}" in template) == (metric == "hallucinate")
        assert ("{end_generation}" in template) == (metric != "hallucinate")


def test_every_flag_is_counted(spark):
    flags = judge.taxonomy({m: F.lit(True) for m in METRICS})
    assert list(flags) == judge.FLAGS and set(judge.ACCURACIES.values()) <= set(flags)


def test_taxonomy_over_all_answers(spark):
    rows = []
    combos = list(itertools.product((True, False), repeat=8))
    for i, combo in enumerate(combos):
        for m, said in zip(METRICS, combo):
            word = "cannot say" if m == "helpful" else "Yes, it does"
            rows.append((i, m, word if said else "maybe"))
    flags = judge.item_flags(spark.createDataFrame(rows, VERDICT), ["item_id"]).collect()
    assert len(flags) == 256
    for r in flags:
        ack, vio, hal, unh, inn, mis, deep, tho = combos[r.item_id]
        hal = ack and hal
        assert r.judged and r.hallucination == hal and r.error_unhelpful == unh and r.misleading == mis
        assert r.error_inconsistent == (ack and not hal and vio and not unh)
        assert r.hallucination_of_preference_violation == (hal and vio and not unh)
        assert r.preference_unaware_violation == (not ack and vio and not unh)
        assert r.preference_adherence_accuracy == (not vio and not unh)
        assert r.quality_aware_accuracy == (inn or deep or tho)


def test_unjudged_items_count_in_the_total_only(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id bigint")
    verdicts = spark.createDataFrame([(1, "thoughtful", "YES"), (1, "thoughtful", "YES"), (2, "helpful", None)], VERDICT)
    flags = judge.item_flags(judge.with_unjudged(verdicts, items, ["item_id"]), ["item_id"])
    report = judge.accuracy_report(judge.error_counters(flags)).first()
    assert (report.total, report.thoughtful, report.preference_adherence_accuracy) == (3, 1, 2)
    assert (report.thoughtful_pct, report.preference_following_pct) == (33.33, 66.67)


def test_report_of_nothing_is_null(spark):
    empty = judge.item_flags(spark.createDataFrame([], VERDICT), ["item_id"])
    report = judge.accuracy_report(judge.error_counters(empty)).first()
    assert (report.total, report.preference_following_pct) == (0, None)


def test_pending_empties_after_ingest(spark):
    items = spark.createDataFrame([(1, "r"), (2, None), (3, "r")], "item_id bigint, response_to_q string")
    some = spark.createDataFrame([(1, m, "") for m in METRICS[:3]] * 2, VERDICT)
    left = judge.pending(items, some)
    assert left.count() == 13
    done = some.unionByName(left.withColumn("answer", F.lit("Yes")))
    assert judge.pending(items, done).count() == 0


def test_verdict_parsing_per_metric(spark):
    df = spark.createDataFrame([
        (1, "acknow", "<preference> likes tea </preference><answer>Yes</answer>"),
        (1, "helpful", "<explanation>why</explanation><ANSWER>No"),
    ], "item_id bigint, metric string, raw string")
    got = {r.metric: (r.answer, r.explanation, r.extract_pref) for r in judge.parse_verdicts(df).collect()}
    assert got == {"acknow": ("Yes", None, "likes tea"), "helpful": ("No", "why", None)}


def test_missing_metrics_and_pivot(spark):
    df = spark.createDataFrame([(1, m, "Yes") for m in METRICS] + [(2, "helpful", "No")], VERDICT)
    wide = {r.item_id: r for r in judge.verdict_pivot(df).collect()}
    assert wide[1].deep_mining == "Yes" and wide[2].helpful == "No" and wide[2].acknow is None
    maps = df.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "answer"))).alias("m"))
    missing = {r.item_id: r.x for r in maps.select("item_id", judge.missing_metrics(F.col("m")).alias("x")).collect()}
    assert missing == {1: [], 2: [m for m in METRICS if m != "helpful"]}


def test_payloads(spark):
    row = spark.range(1).select(judge.request_payload("m", F.lit('say "hi"\n')).alias("j"),
                                judge.critique_payload("c", F.lit("p")).alias("c")).first()
    assert json.loads(row.j) == {
        "model": "m", "stream": False, "max_tokens": 1024, "temperature": 0.0,
        "messages": [{"role": "system", "content": judge.prompts.JUDGE_SYSTEM},
                     {"role": "user", "content": 'say "hi"\n'}]}
    assert json.loads(row.c) == {"model": "c", "prompt": "p", "max_tokens": 1024, "temperature": 0.0,
                                 "stop": ["<|im_end|>"]}


def test_reply_ingest_defaults_to_empty_text(spark):
    requests = spark.createDataFrame([(i,) for i in range(7)], "id int")
    replies = spark.createDataFrame([
        (0, '{"choices": [{"message": {"content": "chat"}}, {"message": {"content": "second"}}]}'),
        (1, '{"choices": [{"text": "completion"}]}'),
        (2, '{"choices": []}'), (3, "not json"), (4, '{"error": 1}'),
        (5, '{"choices": [{"message": {"content": "ok"}}]}'), (5, "broken"),
    ], "id int, body string")
    got = {r.id: r.raw for r in exchange.ingest_replies(requests, replies, ["id"]).collect()}
    assert got == {0: "chat", 1: "completion", 2: "", 3: "", 4: "", 5: "ok", 6: ""}


def test_rubric_files(spark, tmp_path):
    for metric, name in rubrics.RUBRIC_FILES.items():
        (tmp_path / name).write_text(f"ask {metric}\n{{question}}")
    (tmp_path / "check_other.txt").write_text("unused")
    got = {r.metric: r.template for r in rubrics.read_rubrics(spark, str(tmp_path)).collect()}
    assert got == {m: f"ask {m}\n{{question}}" for m in METRICS}


def test_run_lookup(spark, tmp_path):
    rows = [(1, "explicit", "cot", "t", "a"), (2, "explicit", "zero-shot", "t", "a")]
    df = spark.createDataFrame(rows, "item_id int, pref_form string, task string, topic string, model string")
    exchange.write_runs(df, str(tmp_path / "runs"))
    run = {"pref_form": "explicit", "task": "cot", "topic": "t", "model": "a"}
    found = exchange.read_run(spark, str(tmp_path / "runs"), **run)
    assert [r.item_id for r in found.collect()] == [1]
    assert "PartitionFilters: [isnotnull" in found._jdf.queryExecution().executedPlan().toString()
    try:
        exchange.read_run(spark, str(tmp_path / "runs"), **{**run, "model": "b"})
        raise AssertionError("a run without results must be an error")
    except FileNotFoundError:
        pass


def test_coverage(spark):
    topics = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "item_id int, topic string")
    items = spark.createDataFrame([(1, "a", "r"), (2, "a", None), (3, "b", "r")],
                                  "item_id int, topic string, response_to_q string")
    got = {r.topic: (r.responses, r.expected, r.complete) for r in judge.coverage(topics, items, ["topic"]).collect()}
    assert got == {"a": (1, 2, False), "b": (1, 1, True), "c": (0, 1, False)}
    assert sorted(r.item_id for r in judge.missing_items(topics, items, ["item_id"]).collect()) == [2, 4]


REPEATED = [
    (1, "acknow", 5, "No", None, "second"), (1, "acknow", 2, "Yes", None, "first"),
    (1, "helpful", 9, "No", "later", None), (1, "helpful", 3, "Yes", "earlier", None),
    (1, "violate", 1, "Yes", "why", None), (77, "helpful", 1, "No", "of no item", None)]
NUMBERED = ("item_id bigint, metric string, reply_no bigint, answer string, explanation string, extract_pref string")


def test_missing_and_equal_reply_numbers_follow_one_rule(spark, tmp_path):
    rows = [(1, "helpful", None, "No", "a", None), (1, "helpful", 5, "Yes", "b", None)]
    answers = ["Yes", "No", None, "no way", "yes!"]
    rows += [(i, m, 3, answers[(i + k) % 5], f"e{k}", "p") for i in range(2, 42) for m in ("helpful", "violate", "acknow")
             for k in range(3)]
    rows += [(50, "violate", None, a, None, None) for a in ("Yes", "No")]
    df = spark.createDataFrame(rows, "item_id int, metric string, reply_no int, answer string, explanation string, "
                                     "extract_pref string")
    for table in (df.repartition(7), df.orderBy(F.desc("answer")).coalesce(1), df.orderBy("answer")):
        flags = {r.item_id: r for r in judge.item_flags(table, ["item_id"]).collect()}
        pivot = {r.item_id: r for r in judge.verdict_pivot(table).collect()}
        records = {r.item_id: r.verdicts for r in judge.verdict_records(table).collect()}
        assert pivot[1].helpful == "Yes" and not flags[1].error_unhelpful
        assert pivot[50].violate == "No" and not flags[50].violation
        for i in range(2, 42):
            said = {m: (pivot[i][m] or "").lower() for m in ("helpful", "violate", "acknow")}
            assert all(records[i][m].answer == pivot[i][m] for m in said)
            assert flags[i].error_unhelpful == ("no" in said["helpful"])
            assert flags[i].violation == ("yes" in said["violate"])
            assert flags[i].acknowledgement == ("yes" in said["acknow"])
            # of equal numbers an answer without the word counts
            assert "no" not in said["helpful"] and "yes" not in said["violate"]


def test_one_rule_for_repeated_verdicts(spark, tmp_path):
    df = spark.createDataFrame(REPEATED, NUMBERED)
    wide = {r.item_id: r for r in judge.verdict_pivot(df).collect()}[1]
    assert (wide.acknow, wide.acknow_text, wide.helpful, wide.helpful_text) == ("Yes", "first", "Yes", "earlier")
    flags = {r.item_id: r for r in judge.item_flags(df, ["item_id"]).collect()}[1]
    assert flags.acknowledgement and not flags.error_unhelpful and flags.violation
    items = spark.createDataFrame([(1, "p", "q", "r")],
                                  "item_id bigint, preference string, question string, response_to_q string")
    assert [r.extract_pref for r in judge.restatement_pairs(items, df).collect()] == ["first"]
    from stepwright.plans import jobs
    asked = [r.metric for r in jobs.judge_requests(items, df).collect()]
    assert sorted(asked) == sorted(set(METRICS) - {"acknow", "helpful", "violate"})
    # without numbers any order of the rows gives the same choice
    plain = df.drop("reply_no")
    picks = [{(r.item_id, r.metric): r.answer for r in judge.first_verdicts(p).collect()}
             for p in (plain, plain.orderBy(F.desc("answer")), plain.repartition(5))]
    assert picks[0] == picks[1] == picks[2]
    judge.write_verdict_records(df, str(tmp_path / "records"))
    record = [r for f in (tmp_path / "records").glob("part-*") for r in map(json.loads, f.read_text().splitlines())
              if r["item_id"] == 1][0]
    assert record["verdicts"]["acknow"] == {"answer": "Yes", "extract_pref": "first"}


def test_verdicts_of_other_items_do_not_count(spark):
    from stepwright.plans import jobs
    items = spark.createDataFrame([(1, "r", "m")], "item_id bigint, response_to_q string, model string")
    df = spark.createDataFrame(REPEATED, NUMBERED)
    assert jobs.accuracy(items, df).first().total == 1
    assert jobs.accuracy(items, df, ["model"]).first().total == 1


def test_templates_must_be_eight(spark):
    whole = [(m, f"t {m}") for m in METRICS]
    items = spark.createDataFrame([(1,)], "item_id bigint")
    assert judge.with_rubrics(items, spark.createDataFrame(whole * 2, "metric string, template string")).count() == 8
    for wrong in (whole[1:], whole + [(METRICS[0], "another")]):
        try:
            judge.with_rubrics(items, spark.createDataFrame(wrong, "metric string, template string"))
            raise AssertionError("a metric without exactly one template must be an error")
        except ValueError as e:
            assert METRICS[0] in str(e)


def test_readable_and_early_replies_win(spark):
    requests = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    replies = spark.createDataFrame([
        (1, 1, "{"), (1, 2, '{"choices":[{"text":"b"}]}'), (1, 3, '{"choices":[{"text":"c"}]}'),
        (2, 1, "{")], "k int, reply_no int, body string")
    got = {r.k: r.raw for r in exchange.ingest_replies(requests, replies, ["k"]).collect()}
    assert got == {1: "b", 2: "", 3: ""}
    plan = exchange.ingest_replies(requests, replies, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_done_masks(spark):
    items = spark.createDataFrame(
        [(1, "r", "a"), (2, "r", "b"), (3, None, "c"), (4, "r", "d"), (None, "r", "e"), (5, "r", "f")],
        "item_id bigint, response_to_q string, note string")
    verdicts = spark.createDataFrame(
        [(1, m, "x") for m in METRICS] + [(1, "violate", None), (2, "violate", None), (2, "helpful", "y"),
         (2, "helpful", "z"), (3, "acknow", "x"), (4, "other", "x"), (5, None, "x"), (None, "acknow", "x")], VERDICT)
    masks = {r.item_id: r.done for r in judge.done_masks(verdicts).collect()}
    assert masks[1] == 255 and masks[4] == masks[5] == 0
    assert masks[2] == sum(1 << METRICS.index(m) for m in ("violate", "helpful"))
    got = sorted((str(r.item_id), r.note, r.metric) for r in judge.pending(items, verdicts, "note").collect())
    pairs = {(v.item_id, v.metric) for v in verdicts.collect() if v.item_id is not None}
    assert got == sorted((str(i.item_id), i.note, m) for i in items.collect() if i.response_to_q
                         for m in METRICS if (i.item_id, m) not in pairs)


def test_pending_shuffles_items_and_masks_only(spark):
    schema = "item_id bigint, replied boolean"
    items = spark.createDataFrame([(1, True)], schema).repartition(2)
    verdicts = spark.createDataFrame([(1, "acknow", "x")], VERDICT).repartition(2)
    plan = judge.pending(items.hint("merge"), verdicts)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert shuffles and all("hashpartitioning(item_id" in line for line in shuffles)


def test_replies_move_before_they_are_sorted(spark):
    """a limit by rank sorted, and spilled, all reply texts before the shuffle too."""
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "item_id int, metric string")
    body = '{"choices": [{"message": {"content": "%s"}}]}'
    replies = spark.createDataFrame(
        [(1, "a", body % "late", 2), (1, "a", body % "first", 1), (1, "a", "{", 0), (2, "a", "{", 1), (1, "a", body % "none", None)],
        "item_id int, metric string, body string, reply_no int")
    found = exchange.ingest_replies(asked, replies.union(replies), ["item_id", "metric"])
    assert sorted(map(tuple, found.collect())) == [(1, "a", "first"), (2, "a", ""), (3, "a", "")]
    assert "WindowGroupLimit" not in found._jdf.queryExecution().executedPlan().toString()
