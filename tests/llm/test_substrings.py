"""Suffix arrays, common prefixes and removal of repeats against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stepwright.llm import substrings, suffixes
from stepwright.llm.common import BATCH_BYTES, BATCHES
from tests.llm.odd import LONG, by_text, empty, odd


def random_segments(rnd):
    letters = rnd.choice([b"a", b"ab", b"abc", bytes(range(256))])
    out = [bytes(rnd.choice(letters) for _ in range(rnd.randint(1, rnd.choice([3, 25])))) for _ in range(rnd.randint(1, 6))]
    return out + [out[0], out[-1] * 3] if rnd.random() < 0.4 else out


@pytest.mark.parametrize("seed", range(150))
def test_suffix_array_and_common_prefixes(seed):
    segments = random_segments(random.Random(seed))
    t, starts = suffixes.join_segments(segments)
    number = {p: k for k, p in enumerate(np.flatnonzero(t == 0).tolist())}

    def key(i):
        return [number[j] if t[j] == 0 else len(number) + int(t[j]) for j in range(i, len(t))]

    sa = suffixes.suffix_array(t)
    assert sa.tolist() == sorted(range(len(t)), key=key)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
    remaining = np.diff(np.append(starts, len(t)))[owner] - 1 - (np.arange(len(t)) - starts[owner])
    common = suffixes.permuted_lcp(t, sa, remaining)
    for before, i in zip(sa, sa[1:]):
        n = 0
        while t[i + n] == t[before + n] != 0:
            n += 1
        assert common[i] == n


def brute(rows, length):
    """Rows (id, text); of equal ids, no start removes an equal one."""
    first = {}
    for i, text in rows:
        raw = text.encode()
        for k in range(len(raw) - length + 1):
            at = (i is not None, i or 0, k)
            first[raw[k:k + length]] = min(at, first.get(raw[k:k + length], at))
    out = []
    for i, text in rows:
        raw = text.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k:k + length]] < (i is not None, i or 0, k):
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), runs,
                    hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def found(docs, length=100, group_regions=substrings.GROUP_REGIONS):
    rows = substrings.removal_digests(docs, length, group_regions).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) for x in r])


def test_small_table(small, small_rows):
    assert found(small) == brute(small_rows, 100)


@pytest.mark.parametrize("group_regions", [substrings.GROUP_REGIONS, 1])
def test_families_passages_and_runs(spark, group_regions):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(400))
    rows = []
    for i in range(60):
        own = "".join(rnd.choice("abcdefghijé ") for _ in range(rnd.randint(0, 500)))
        cut = rnd.randrange(300)
        rows.append((i, own + rnd.choice(["", passage, passage[cut:cut + rnd.choice([99, 100, 101, 180])]])
                     + own[:rnd.randint(0, 200)] + rnd.choice(["", "z" * 130, "xy" * 90]), None, None, None))
    rows += [(100 + i, rows[i % 5][1], None, None, None) for i in range(20)]           # copies
    rows += [(200 + i, passage[:200] + f"#{i}" + passage[200:], None, None, None) for i in range(20)]  # near copies
    rnd.shuffle(rows)
    assert found(odd(spark, rows), 100, group_regions) == brute([(r[0], r[1]) for r in rows], 100)


def test_odd_rows(spark, odd_docs):
    assert found(odd_docs) == brute(by_text(), 100)
    assert found(empty(spark)) == []


def test_a_long_text_of_one_period(spark):
    rows = [(1, LONG[:60_000], None, None, None), (2, "ab" * 3000, None, None, None), (3, "b" + "ab" * 60, None, None, None)]
    assert found(odd(spark, rows)) == brute([(r[0], r[1]) for r in rows], 100)


def test_kept_bytes(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    rows = [(1, text, None, None, None), (2, "before " + text + " after", None, None, None)]
    kept = {r.doc_id: bytes(r.kept) for r in substrings.remove_repeats(odd(spark, rows)).collect()}
    assert kept == {1: text.encode(), 2: b"before  after"}


@pytest.mark.parametrize("own", [None, str(5 << 20)])
def test_python_gets_texts_in_small_batches(spark, monkeypatch, own):
    """16 MB of texts in one partition, and fewer rows than Spark's batch; a session's own setting stays."""
    if own:
        spark.conf.set(BATCHES, own)
    else:
        spark.conf.unset(BATCHES)
    docs = spark.range(0, 1_600, 1, 1).selectExpr("id AS doc_id", "concat(repeat('word ', 2000), id) AS text")
    found, find = [], substrings._instances

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    def measured(rows, length):
        found.append(rows.select("raw").mapInArrow(sizes, "size bigint").agg(F.max("size"), F.count("size")).first())
        return find(rows.where("did < 2"), length)

    monkeypatch.setattr(substrings, "_instances", measured)
    try:
        substrings.repeated_spans(substrings._documents(docs))
    finally:
        spark.conf.unset(BATCHES)
    (most, n), = found
    if own:
        assert 4 << 20 < most < 6 << 20
    else:
        assert most < 1.1 * BATCH_BYTES and n >= 7
