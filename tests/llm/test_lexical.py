"""Lexical search against scoring every document; trees, bounds and odd rows."""

import collections
import math
import re
import string

import numpy as np

from stepwright.llm import lexical
from tests.llm.odd import ROWS, empty, odd

ITEMS = "item_id bigint, text string, score int, row int, terms int, shard int"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    docs = [(i, collections.Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is not None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, k=10):
    items = spark.createDataFrame([(i, t, 0, 0, 0, 0) for i, t in items], ITEMS)
    return sorted((tuple(r) for r in lexical.rank(docs, items, k).collect()), key=str)


def test_odd_documents(spark, odd_docs):
    items = [(1, "The lazy dog runs"), (2, None), (3, ""), (4, "nothing anywhere"), (5, "word7 and3 word7 word9"),
             (None, "Text nichts"), (6, "日本語のテキスト x"), (6, "idiot 1d10t іdiot"), (7, "dog " * 5000 + "fox")]
    found = ranked(spark, odd_docs, items)
    assert found == plain([(i, t) for i, t, *_ in ROWS], items)
    assert {r[0] for r in found} == {1, 5, 6, 7, None}


def test_ties_copies_and_many_rows(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.3, 30) if x < 500) for _ in range(700)]
    docs = [(int(i), t) for i, t in zip(rng.permutation(700), texts)] + [(1000 + i, texts[3]) for i in range(600)]
    docs += [(5000 + i, "t1") for i in range(40)] + [(None, texts[3]), (None, texts[4])]
    items = [(i, texts[i]) for i in range(12)] + [(50, "t1"), (51, "t499 t2 T2")]
    df = odd(spark, [(i, t, None, None, 1) for i, t in docs]).repartition(9)
    assert ranked(spark, df, items) == plain(docs, items)
    assert ranked(spark, df, items, k=3) == plain(docs, items, 3)


def test_empty_tables(spark, odd_docs):
    assert ranked(spark, empty(spark), [(1, "a dog")]) == []
    assert ranked(spark, odd_docs, []) == []
    assert ranked(spark, odd(spark, [(1, None, None, None, 0), (2, "", None, None, 0)]), [(1, "a")]) == []


def test_groups_and_shards_don_t_change_results(spark, monkeypatch, small, small_rows):
    items = [(i, t[:300]) for i, t in small_rows[:20]]
    expected = plain(small_rows, items)
    assert ranked(spark, small, items) == expected
    for name, value in (("GROUP_TERMS", 50), ("SHARD_ROWS", 9), ("LEAF_POINTS", 1), ("FIRST", 1)):
        monkeypatch.setattr(lexical, name, value)
    assert ranked(spark, small, items) == expected


def points(rng, n, width, families):
    """Families of points near one another."""
    heads = [np.flatnonzero(rng.random(width) < 0.1) for _ in range(families)]
    rows = []
    for i in range(n):
        own = np.unique(np.concatenate((heads[i % families], rng.integers(0, width, 2))))
        rows.append((own, rng.integers(1, 1_000_000, len(own))))
    at = np.concatenate(([0], np.cumsum([len(c) for c, _ in rows])))
    return rows, at, np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows])


def test_no_score_is_above_its_balls_bounds():
    rng = np.random.default_rng(7)
    rows, at, columns, values = points(rng, 900, 300, 30)
    tree = lexical.BallTree(at, columns, values, 300)
    assert sorted(tree.order.tolist()) == list(range(900))
    for _ in range(25):
        asked = np.sort(rng.choice(300, 12, replace=False))
        weights = rng.integers(1, 12_000, 12)
        full = np.zeros(300, np.int64)
        full[asked] = weights
        exact = np.array([int((full[c] * v).sum()) for c, v in rows])
        for b, low, high in zip(tree.bounds(asked, weights), tree.low, tree.high):
            assert b >= exact[tree.order[low:high]].max()
        best, scored = tree.search(asked, weights, [[i] for i in range(900)], 5, 0)
        assert best == [(-s, i) for s, i in sorted((-int(s), i) for i, s in enumerate(exact) if s > 0)[:5]]
        tenth = sorted(exact.tolist())[-10]
        assert tree.search(asked, weights, [[i] for i in range(900)], 5, tenth)[0] == best


def test_families_are_pruned():
    rng = np.random.default_rng(8)
    centres = [np.sort(rng.choice(400, 20, replace=False)) for _ in range(40)]
    rows = [(centres[i % 40], 500_000 + rng.integers(0, 3000, 20)) for i in range(2000)]
    at = np.concatenate(([0], np.cumsum([len(c) for c, _ in rows])))
    tree = lexical.BallTree(at, np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]), 400)
    _, scored = tree.search(centres[3], np.full(20, 5000), [[i] for i in range(2000)], 10, 0)
    assert scored < 1000
