"""Streams over files that arrive one after the other."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stepwright.operators.judge import parse_verdicts
from stepwright.streaming import rollup, verdicts

REPLY = "item_id bigint, metric string, reply_no bigint, raw string"


def add_file(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def ingest(spark, tmp_path, progress="progress"):
    stream = spark.readStream.schema(REPLY).parquet(str(tmp_path / "in"))
    verdicts.ingest_verdicts(stream, str(tmp_path / "table"), str(tmp_path / progress))
    rows = verdicts.read_verdicts(spark, str(tmp_path / "table")).collect()
    return sorted(((r.item_id, r.metric, r.answer) for r in rows), key=lambda r: (r[0] is not None, r))


def test_first_verdict_stays(spark, tmp_path):
    folder = str(tmp_path / "in")
    add_file(spark, folder, [(1, "helpful", 2, "<answer>late</answer>"), (1, "helpful", 1, "<answer>No</answer>"),
                             (1, "acknow", 3, "none")], REPLY)
    first = [(1, "acknow", ""), (1, "helpful", "No")]
    assert ingest(spark, tmp_path) == first
    assert ingest(spark, tmp_path) == first   # nothing new
    add_file(spark, folder, [(1, "helpful", 4, "<answer>Yes</answer>"), (2, "helpful", 5, "<answer>Yes</answer>")], REPLY)
    assert ingest(spark, tmp_path) == first + [(2, "helpful", "Yes")]
    # a query that lost its progress reads all again and changes nothing
    assert ingest(spark, tmp_path, "progress2") == first + [(2, "helpful", "Yes")]


def test_a_hot_pair_leaves_one_verdict_and_equals_the_batch(spark, tmp_path):
    rows = [(7, "violate", i, f"<answer>{i}</answer>") for i in range(500)] + [
        (i, "violate", 1000 + i, "<answer>Yes</answer>") for i in range(50, 60)]
    add_file(spark, str(tmp_path / "in"), rows, REPLY)
    got = ingest(spark, tmp_path)
    batch = parse_verdicts(spark.createDataFrame(rows, REPLY)).groupBy("item_id", "metric").agg(
        F.min_by("answer", "reply_no").alias("answer")).collect()
    assert got == sorted(map(tuple, batch)) and len(got) == 11


def test_a_rewritten_table_reads_the_same(spark, tmp_path, monkeypatch):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = [(i, m, 10 * i + n, f"<answer>{i} {n}</answer>") for i in range(6) for m in ("helpful", "violate") for n in (2, 1)]

    def read():
        return sorted(read_all(spark, table))

    add_file(spark, folder, rows, REPLY)
    ingest(spark, tmp_path)
    before = read()
    assert len(before) == 12 and all(r[2] == f"{r[0]} 1" for r in before)
    # a rewrite that fails before its end leaves what there was
    with monkeypatch.context() as m:
        m.setattr(verdicts, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            verdicts.compact_verdicts(spark, table)
    assert read() == before
    assert verdicts.compact_verdicts(spark, table) == 1
    assert read() == before
    # pairs that come again, with smaller and larger numbers, and new ones
    add_file(spark, folder, [(1, "helpful", 0, "<answer>first</answer>"), (2, "helpful", 99, "<answer>late</answer>"),
                             (7, "violate", 5, "<answer>new</answer>"), (None, "violate", 5, "<answer>null</answer>")], REPLY)
    ingest(spark, tmp_path)
    after = {r[:2]: r[2] for r in read_all(spark, table)}
    assert after[1, "helpful"] == "first" and after[2, "helpful"] == "2 1" and after[7, "violate"] == "new"
    assert len(after) == 14
    assert verdicts.compact_verdicts(spark, table) == 2
    assert {r[:2]: r[2] for r in read_all(spark, table)} == after
    # the failed rewrite, the first one with its record, and both batches
    assert verdicts.remove_compacted(spark, table) == 5
    assert {r[:2]: r[2] for r in read_all(spark, table)} == after
    # a query that lost its progress reads all again and changes nothing
    ingest(spark, tmp_path, "progress2")
    assert {r[:2]: r[2] for r in read_all(spark, table)} == after


def read_all(spark, table):
    return [tuple(r) for r in verdicts.read_verdicts(spark, table).collect()]


def test_rewritten_rows_are_not_sorted_again(spark, tmp_path):
    add_file(spark, str(tmp_path / "in"), [(i, "helpful", i, "<answer>No</answer>") for i in range(50)], REPLY)
    ingest(spark, tmp_path)
    verdicts.compact_verdicts(spark, str(tmp_path / "table"))
    plan = verdicts.read_verdicts(spark, str(tmp_path / "table"))._jdf.queryExecution().executedPlan().toString()
    untouched = plan[plan.index("Union"):plan.index("Window")]
    assert "LeftAnti" in untouched and "Sort" not in untouched.split("Project")[1]


def test_repeated_deliveries_are_dropped_by_the_stream(spark, tmp_path):
    timed = "ts timestamp, " + REPLY
    moment = datetime(2024, 1, 1)
    rows = [(moment, 1, "helpful", 1, "<answer>No</answer>")] * 40 + [(moment, 1, "helpful", 0, "<answer>Yes</answer>")]
    add_file(spark, str(tmp_path / "in"), rows, timed)
    for _ in range(2):
        stream = spark.readStream.schema(timed).parquet(str(tmp_path / "in"))
        verdicts.ingest_verdicts(stream, str(tmp_path / "table"), str(tmp_path / "progress"), within="1 hour")
        add_file(spark, str(tmp_path / "in"), rows, timed)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    assert [r[2] for r in read_all(spark, str(tmp_path / "table"))] == ["Yes"]


POINT = "ts timestamp, metric string, value double"


def point(minute, value, metric="m", day=1):
    return (datetime(2024, 1, day, 0, minute), metric, value)


def test_rollup_equals_the_batch_and_drops_only_rows_past_the_watermark(spark, tmp_path):
    folder, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))

    def run():
        stream = spark.readStream.schema(POINT).parquet(folder)
        rollup.stream_rollup(stream, table, progress, "10 minutes", "1 hour")
        return {(r.window_start.isoformat(), r.metric): (r.value, r.points)
                for r in rollup.read_rollup(spark, table).collect()}

    first = [point(1, 1.0), point(5, 3.0), point(12, 5.0), point(12, 1.0, "n")]
    add_file(spark, folder, first, POINT)
    batch = {(r.window_start.isoformat(), r.metric): (r.value, r.points) for r in rollup.windowed_means(
        spark.createDataFrame(first, POINT), "10 minutes").collect()}
    assert run() == batch
    add_file(spark, folder, [point(2, 8.0), point(0, 1.0, day=3)], POINT)   # late, but within the hour
    assert run()["2024-01-01T00:00:00", "m"] == (4.0, 3)
    add_file(spark, folder, [point(3, 99.0)], POINT)   # two days late
    assert run()["2024-01-01T00:00:00", "m"] == (4.0, 3)


def test_rollup_begun_anew_replaces_the_old_run(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    width = "10 minutes"

    def run(progress):
        stream = spark.readStream.schema(POINT).parquet(folder)
        rollup.stream_rollup(stream, table, str(tmp_path / progress), width, "1 hour")
        return {(r.window_start.isoformat(), r.metric): (r.value, r.points)
                for r in rollup.read_rollup(spark, table).collect()}

    rows = []
    for i in range(3):  # three batches, so that the first run has high batch numbers
        rows.append(point(i, float(i)))
        add_file(spark, folder, rows[-1:], POINT)
        run("first")
    rows.append(point(4, 9.0))
    add_file(spark, folder, rows[-1:], POINT)
    batch = {(r.window_start.isoformat(), r.metric): (r.value, r.points) for r in rollup.windowed_means(
        spark.createDataFrame(rows, POINT), width).collect()}
    assert run("second") == batch
    assert run("second") == batch


def test_a_batch_does_not_read_the_table(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i in range(3):
        add_file(spark, folder, [(1, "helpful", 10 - i, f"<answer>{i}</answer>"), (i, "violate", i, "x")], REPLY)
        got = ingest(spark, tmp_path)
    assert (1, "helpful", "2") in got and len(got) == 4  # the smallest number, though it came last
    for part in (tmp_path / "table").glob("run=*/batch_id=0/*.parquet"):
        part.unlink()
    add_file(spark, folder, [(9, "helpful", 1, "<answer>Yes</answer>")], REPLY)
    assert (9, "helpful", "Yes") in ingest(spark, tmp_path)


def test_a_table_without_replies_is_empty(spark, tmp_path):
    spark.createDataFrame([], REPLY).write.parquet(str(tmp_path / "in"))
    assert ingest(spark, tmp_path) == []
