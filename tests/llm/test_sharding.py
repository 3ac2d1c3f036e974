"""Sharding: a permutation, law of rows, computable both ways."""

import zlib
from collections import Counter

import numpy as np
import pytest

from stepwright.llm import sharding
from tests.llm.odd import by_text, empty, rows_of


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_and_its_inverse(total):
    numbers = np.arange(total)
    place = sharding.permute(numbers, total, seed=7)
    assert sorted(place.tolist()) == numbers.tolist()
    assert sharding.permute(place, total, 7, back=True).tolist() == numbers.tolist()
    assert total < 100 or (sharding.permute(numbers, total, 8) != place).mean() > 0.9


def test_shuffle_looks_random():
    place = sharding.permute(np.arange(10_000), 10_000, seed=1)
    assert abs(np.corrcoef(np.arange(10_000), place)[0, 1]) < 0.05
    assert abs(np.corrcoef(place[:-1], place[1:])[0, 1]) < 0.05


def test_law_of_rows(spark, small, small_rows):
    found = sharding.shard_rows(small, 40, seed=3).collect()
    assert len(found) == len(small_rows)
    texts = dict(small_rows)
    for r in found:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    counts = Counter(r.shard for r in found)
    assert max(counts.values()) - min(counts[s] for s in range(40)) <= 1
    for s in range(40):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))
    ordered = sorted(found, key=lambda r: r.doc_id)
    shard, slot = sharding.locate(np.arange(len(found)), len(found), 40, seed=3)
    assert [(r.row_number, r.shard, r.slot) for r in ordered] == list(zip(range(len(found)), shard, slot))
    assert sharding.row_at(shard, slot, len(found), 40, seed=3).tolist() == list(range(len(found)))


def test_result_does_not_depend_on_partitions(spark, small):
    a = rows_of(sharding.shard_rows(small, 7), "doc_id", "shard", "slot")
    assert rows_of(sharding.shard_rows(small.repartition(5, "lang"), 7), "doc_id", "shard", "slot") == a


def test_odd_rows(spark, odd_docs):
    found = sharding.shard_rows(odd_docs, 4)
    assert rows_of(found, "doc_id", "size", "text_crc32") == sorted(
        ((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in by_text()),
        key=lambda r: [(x is not None, x) for x in r])
    assert sorted(r.row_number for r in found.collect()) == list(range(len(by_text())))
    assert sharding.shard_rows(empty(spark), 4).count() == 0
