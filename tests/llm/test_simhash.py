"""SimHash links and components against all pairs; sections against exact similarity."""

import random
import re

import pytest
import xxhash

from stepwright.llm import sections, simhash
from stepwright.llm.graph import components
from tests.llm.odd import by_text, empty, odd


def reference_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    grams = [" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, linked):
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def brute(rows):
    """(doc_id, fingerprint, smallest id reachable)."""
    points = sorted({f for _, f in rows})
    group = dict(zip(points, classes(points, lambda a, b: bin(a ^ b).count("1") <= 2)))
    least = {}
    for i, f in rows:
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return sorted(((i, f, least.get(group[f])) for i, f in rows), key=lambda r: [(x is not None, x) for x in r])


def found(docs):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()),
                  key=lambda r: [(x is not None, x) for x in r])


def test_small_table(small, small_rows):
    assert found(small) == brute([(i, reference_fingerprint(t)) for i, t in small_rows])


def test_odd_rows(spark, odd_docs):
    assert found(odd_docs) == brute([(i, reference_fingerprint(t)) for i, t in by_text()])
    assert found(empty(spark)) == []


@pytest.mark.parametrize("cell_points", [64, 1])
def test_links_connect_what_is_within_two_bits(spark, cell_points):
    rnd = random.Random(5)
    points = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(260):
        p = rnd.choice(points)
        for b in rnd.sample(range(64), rnd.choice([1, 2, 2, 3])):
            p ^= 1 << b
        points.append(p)
    points = sorted(set(points) | {0, 1, 1 << 63, 2**64 - 1})
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in points], "fp bigint")
    edges = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(df, cell_points).collect()]
    assert all(bin(u ^ v).count("1") <= 2 for u, v in edges)
    near = set(edges) | {(v, u) for u, v in edges}
    wanted = classes(points, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert classes(points, lambda a, b: (a, b) in near) == wanted
    if cell_points > 60:  # in sparse cells links are complete
        assert len(edges) >= sum(bin(a ^ b).count("1") <= 2 for a in points for b in points if a < b) * 0.5


def test_manhattan_is_a_lower_bound(spark):
    rnd = random.Random(6)
    pairs = [(rnd.getrandbits(63), rnd.getrandbits(63)) for _ in range(50)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select(
        "a", "b", simhash.manhattan(simhash.embedding(F.col("a")), simhash.embedding(F.col("b"))).alias("d"))
    for a, b, d in df.collect():
        counts = [[bin(x >> s & 3).count("1") for s in range(0, 64, 2)] for x in (a, b)]
        assert d == sum(abs(x - y) for x, y in zip(*counts)) <= bin(a ^ b).count("1")


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    label = {r.node: r.label for r in components(df).collect()}
    assert {label[i] for i in range(201)} == {0}
    assert {label[1000 + i] for i in range(300)} == {1000}
    assert label[5000] == label[4000] == 4000 and len(label) == 503
    assert components(df.limit(0)).count() == 0


def test_sections_group_near_copies(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(2000)]
    rows, family = [], {}
    for base in range(12):
        text = [rnd.choice(words) for _ in range(rnd.choice([40, 120, 400, 2000]))]
        shared = "this licence line stands in every single document of the whole table without any change".split()
        for copy in range(4):
            own = list(text)
            for _ in range(len(own) // 100 if copy else 0):
                own[rnd.randrange(len(own))] = "changed"
            rows.append((base * 10 + copy, " ".join(own + shared * (base % 2)), None, None, None))
            family[base * 10 + copy] = base * 10
    result = sections.groups(odd(spark, rows))
    keys = {r.key: r.did for r in result.collect()}
    assert {r.did: keys[r.keeper] for r in result.collect()} == family


def test_sections_of_odd_rows(spark, odd_docs):
    result = sections.groups(odd_docs).collect()
    assert len(result) == len(by_text())
    of = {r.key: r.did for r in result}
    keeper = {r.did: of[r.keeper] for r in result}
    low = -(1 << 63)
    assert keeper[1] == keeper[2] == 1 and keeper[10] == keeper[11] == 10 and keeper[12] == 12
    assert keeper[3] == keeper[4] == keeper[5] == low  # no words, as one of the rows without id
    assert sections.groups(empty(spark)).count() == 0


def test_crowded_sections(spark):
    rnd = random.Random(8)
    text = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(150):  # one family, larger than a crowd
        own = list(text)
        for _ in range(2):
            own[rnd.randrange(300)] = f"c{i}"
        rows.append((i, " ".join(own), None, None, None))
    for i in range(150):  # unrelated texts with a common passage
        rows.append((1000 + i, " ".join([f"z{rnd.random()}" for _ in range(200)] + text[:60]), None, None, None))
    result = sections.groups(odd(spark, rows)).where("key = keeper").collect()
    assert sorted(r.did for r in result) == [0, *range(1000, 1150)]


