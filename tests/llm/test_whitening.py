"""Whitening against exact fractions; odd vectors."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from stepwright.llm import queries, whitening
from tests.conftest import SMALL

SCHEMA = "vec_id bigint, embedding array<float>, label int, n bigint, whitened int, length int"


def whole(v):
    return tuple(math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v)


def taking_part(rows):
    return [(i, whole(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def held_against(found, rows):
    """Every column of the query for vectors of one length, against the contract's own words."""
    rows = taking_part(rows)
    fit = sorted({x for _, x in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[float(Fraction(n * x[k] - sums[k], n)) for k in range(d)] for x in fit])
    v = centred.T @ centred / n
    values = np.linalg.eigvalsh(v)[::-1][:16]
    assert len(found) == len(rows) * min(16, d)
    by_row = {}
    for r in found:
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error <= 1e-9
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(v), rel_tol=1e-9, abs_tol=1e-15)
    copies = {}
    for i, x in rows:
        copies.setdefault(i, []).append(x)
    for i, xs in copies.items():
        deviations = sorted(sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs)
        assert sorted(by_row[i]) == list(range(1, min(16, d) + 1))
        for c, rs in by_row[i].items():
            assert sorted(r.deviation for r in rs) == deviations
    # axes from the rows themselves: whitened = centred @ axis / sqrt(e)
    single = {i: xs[0] for i, xs in copies.items() if len(xs) == 1}
    x = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(single[i], sums)] for i in single])
    for c in range(1, min(16, d) + 1):
        if values[c - 1] < 1e-9:
            continue
        w = np.array([by_row[i][c][0].whitened for i in single])
        axis = np.linalg.lstsq(x, w * math.sqrt(values[c - 1]), rcond=None)[0]
        assert abs(np.linalg.norm(axis) - 1) < 1e-8
        assert np.allclose(v @ axis, values[c - 1] * axis, atol=1e-8 * values[0])


def test_small_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    held_against(queries.op13_whitening(spark, SMALL).collect(), rows)


def query(spark, rows, folder):
    spark.createDataFrame([(i, v, 0, 0, 0, 0) for i, v in rows], SCHEMA).repartition(5).write.parquet(
        f"{folder}/embeddings.parquet")
    return queries.op13_whitening(spark, str(folder)).collect()


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, [1, 30, 0.2, 5]).tolist()) for i in range(300)]
    rows += [(i + 1000, rows[7][1]) for i in range(200)]  # one vector many times
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [float("nan")] * 4), (2003, [float("-inf")] * 4)]
    rows += [(7, rows[7][1])]
    held_against(query(spark, rows, tmp_path), rows)


def test_null_ids_empty_vectors_and_lengths_apart(spark, tmp_path):
    rng = np.random.default_rng(4)
    threes = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(None, [1.0, 2.0, 3.0])]
    found = query(spark, threes + [(500, []), (501, [2.0]), (502, [1.0, 1.0])], tmp_path)
    assert {r.n for r in found if r.vec_id in (501, 502)} == {1}
    assert all(r.whitened is None and r.explained is None and r.deviation == 0 for r in found if r.vec_id in (501, 502))
    assert not [r for r in found if r.vec_id == 500]
    assert sorted(r.component for r in found if r.vec_id is None) == [1, 2, 3]
    assert {r.n for r in found if r.vec_id in (None, 3)} == {41}


def test_no_variance_in_some_directions(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, (60, 2)).astype(float)
    rows = [(i, [a, b, a + b, 7.0]) for i, (a, b) in enumerate(base.tolist())]
    found = query(spark, rows, tmp_path)
    assert {r.component for r in found if r.whitened is not None} == {1, 2}
    assert all(r.explained == 0 for r in found if r.component > 2)
    held_against(found, rows)


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_huge_components_are_held_and_exact(spark, tmp_path):
    found = query(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])], tmp_path)
    assert len(found) == 6 and {r.n for r in found} == {3}
    assert {r.deviation for r in found if r.vec_id == 1} == {2**63 - 1}


def test_scatter_is_exact():
    rng = np.random.default_rng(6)
    for low, high in ((-64, 64), (0, 1), (-(2**44), 2**44), (10**6 - 5, 10**6 + 5)):
        z = rng.integers(low, high + 1, (131, 5))
        sums, cross = whitening.scatter(z)
        exact = z.astype(object)
        assert (sums == exact.sum(axis=0)).all()
        assert (np.triu(cross) == np.triu(exact.T @ exact)).all()


def test_result_does_not_depend_on_the_tasks(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    one, many = (whitening.whiten(vectors.repartition(k)).select(
        "vec_id", "deviation", F.transform("whitened", F.abs).alias("w")).orderBy("vec_id").collect() for k in (1, 7))
    for a, b in zip(one, many):
        assert a.vec_id == b.vec_id and a.deviation == b.deviation and np.allclose(a.w, b.w)
