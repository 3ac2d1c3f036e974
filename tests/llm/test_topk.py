"""Exact top-k against brute force, ties, odd vectors."""

import math

import numpy as np

from stepwright.llm import topk
from tests.conftest import SMALL

SCHEMA = "vec_id bigint, embedding array<float>, label int, score int, n int"


def brute(rows, k, every):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(rows):
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(rows)
                             if m != n and len(w) == len(v)))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(df, k, every):
    return sorted(tuple(r) for r in topk.top_k(df, k, f"vec_id % {every} = 0").collect())


def test_small_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert found(df, 5, 50) == brute(rows, 5, 50)


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]  # many ties
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (105, [float("inf"), 0.0, 0.0, 0.0]),
             (None, [1.0] * 4), (110, []), (115, [1.0, 2.0]), (120, [1.0] * 4), (120, [1.0] * 4), (-5, [0.001] * 4)]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], SCHEMA)
    assert found(df, 5, 5) == brute(rows, 5, 5)
    assert found(df.limit(0), 5, 5) == []
    assert found(df.where("vec_id = 0"), 5, 5) == []


def test_one_vector_many_times(spark):
    rows = [(i, [0.5, 0.5]) for i in range(1500)]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], SCHEMA)
    best = found(df, 5, 500)
    assert [(q, r, i) for q, r, i, _ in best] == [
        (q, r, i) for q in (0, 500, 1000) for r, i in enumerate([x for x in range(6) if x != q][:5], 1)]


def test_large_numbers_are_exact():
    q, s = np.array([[2.0**40, 3.0]]), np.array([[2.0**20 + 1, 5.0], [2.0**60, 2.0**60]])
    assert topk.products(q, s).tolist() == [[2**40 * (2**20 + 1) + 15, 2**63 - 1]]
