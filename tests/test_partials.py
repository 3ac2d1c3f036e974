"""Stored partial aggregates: increments equal one full run."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stepwright.operators import metrics, partials

POINTS = "mode string, step bigint, metric string, value double, shard string"


def log(seed=1, steps=60):
    rng = random.Random(seed)
    return [(rng.choice(["train", "eval"]), step, m, rng.choice([rng.random(), math.nan, None, -2.0]), shard)
            for step in range(steps) for shard in ("a", "b", None) for m in ("kl", "clip") if rng.random() < 0.9]


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_increments_equal_one_run(spark, tmp_path):
    points = spark.createDataFrame(log(), POINTS)
    whole, parts = f"{tmp_path}/whole", f"{tmp_path}/parts"
    partials.extend(points, whole)
    # shards get ahead of each other; a rerun over all of the log adds only what is new
    partials.extend(points.where("step < 13"), parts)
    partials.extend(points.where("step < 37 and shard = 'a'"), parts)
    partials.extend(points, parts)
    nothing = partials.extend(points, parts)
    assert spark.read.parquet(nothing).isEmpty()
    want = rows(partials.rollup(partials.read_partials(spark, whole)))
    assert rows(partials.rollup(partials.read_partials(spark, parts))) == want
    partials.compact(spark, parts, f"{tmp_path}/compact")
    one = partials.read_partials(spark, f"{tmp_path}/compact")
    assert rows(partials.rollup(one)) == want
    assert partials.new_points(points, one).isEmpty()
    assert one.count() == partials.read_partials(spark, whole).count()


def test_nan_is_kept_apart(spark):
    points = spark.createDataFrame(log(2), POINTS)
    got = {tuple(r)[:3]: r for r in partials.rollup(partials.metric_partials(points)).collect()}
    groups = {}
    for mode, step, metric, value, _ in log(2):
        groups.setdefault((mode, step // 8, f"eval_{metric}" if mode == "eval" else metric), []).append(value)
    assert set(got) == set(groups)
    for key, values in groups.items():
        numbers = [v for v in values if v is not None and not math.isnan(v)]
        r = got[key]
        assert (r.points, r.nan_points) == (len(numbers), sum(v is not None and math.isnan(v) for v in values))
        assert (r.low, r.high) == ((min(numbers), max(numbers)) if numbers else (None, None))
        assert r.value == (pytest.approx(sum(numbers) / len(numbers)) if numbers else None)
    plain = {tuple(r)[:3]: r for r in metrics.metric_rollup(points.where(~F.isnan("value"))).collect()}
    assert all(plain[k].value == pytest.approx(got[k].value) for k in plain if plain[k].points)


def test_a_failed_increment_is_not_read(spark, tmp_path):
    points, table = spark.createDataFrame(log(3, 20), POINTS), f"{tmp_path}/t"
    assert partials.read_partials(spark, table).count() == 0
    folder = partials.extend(points, table)
    want = rows(partials.rollup(partials.read_partials(spark, table)))
    (tmp_path / "t" / folder.split("/")[-1] / "_SUCCESS").unlink()
    assert partials.read_partials(spark, table).count() == 0
    partials.extend(points, table)
    assert rows(partials.rollup(partials.read_partials(spark, table))) == want


def test_plan_combines_before_the_shuffle(spark, tmp_path):
    points = spark.createDataFrame(log(4, 10), POINTS)
    plan = partials.metric_partials(points)._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan and plan.count("Exchange hashpartitioning") == 1
