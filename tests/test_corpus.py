"""Golden, brute-force and property tests of corpus preparation."""

import math
import random

from pyspark.sql import functions as F

from stepwright.functions.text import STEP_SEPARATOR as SEP
from stepwright.operators import corpus, skew
from stepwright.sources import schemas
from stepwright.sources.workspace import written


def node(children=(), thought="t", reasoning="r", score=0.1):
    return (None if children is None else [str(c) for c in children], thought, reasoning, score)


def paths_of(spark, tree, question="q", profile="p"):
    df = spark.createDataFrame([(1, question, profile, tree)], "idx bigint, " + schemas.THOUGHT_TREE)
    return corpus.tree_paths(df).orderBy("path_no").collect()


def test_paths_in_depth_first_order(spark):
    tree = {"0": node([2, 1]), "1": node([3]), "2": node([5, 4]), "3": node(), "4": node(), "5": node(None)}
    assert [r.ids for r in paths_of(spark, tree)] == [["2", "5"], ["2", "4"], ["1", "3"]]


def test_root_only_missing_root_and_empty_fields(spark):
    assert paths_of(spark, {"0": node()}) == []
    assert paths_of(spark, {"1": node()}) == []
    assert paths_of(spark, {}) == []
    tree = {"0": node([1]), "1": node()}
    assert paths_of(spark, tree, question="") == []
    assert paths_of(spark, tree, profile=None) == []
    assert len(paths_of(spark, tree)) == 1


def test_dangling_children_do_not_promote_their_parent(spark):
    tree = {"0": node([1, 9, 2]), "1": node([7, 8]), "2": node([3, 7]), "3": node(),
            "8": (None, None, None, None)}
    assert [r.ids for r in paths_of(spark, tree)] == [["2", "3"]]


def test_shared_child_is_repeated_and_cycle_stops(spark):
    shared = {"0": node([1, 2]), "1": node([3]), "2": node([3]), "3": node()}
    assert [r.ids for r in paths_of(spark, shared)] == [["1", "3"], ["2", "3"]]
    cycle = {"0": node([1]), "1": node([2, 3]), "2": node([1, 0]), "3": node()}
    assert [r.ids for r in paths_of(spark, cycle)] == [["1", "3"]]
    df = spark.createDataFrame([(1, "q", "p", cycle), (2, "q", "p", shared)], "idx bigint, " + schemas.THOUGHT_TREE)
    assert [tuple(r) for r in corpus.cyclic_records(df).collect()] == [(1, 2)]


def test_process_labels_and_defaults(spark):
    tree = {"0": node([1]), "1": node([2], thought=" first"), "2": node([], None, None, None)}
    tree["2"] = ([], "", None, None)
    row = paths_of(spark, tree)[0]
    assert row.process == f"Step 1:  first{SEP}Step 2:"
    assert [tuple(x) for x in row.label] == [("r", 0.1), ("", 0.0)]
    assert row.final_score == "0.0"


def brute_paths(tree):
    found = []

    def walk(key, path):
        n = tree.get(key)
        if not n:
            return
        path = path + [key]
        if not n[0]:
            found.append(path)
        for c in n[0] or []:
            walk(c, path)

    for c in (tree.get("0") or ([],))[0] or []:
        walk(c, [])
    return found


def test_random_trees_against_brute_force(spark):
    rng = random.Random(11)
    trees = []
    for _ in range(60):
        n = rng.randint(1, 30)
        children = {i: [] for i in range(n)}
        for i in range(1, n):
            children[rng.randrange(i)].append(i)
        tree = {}
        for i in range(n):
            kids = children[i] + [100 + i] * (rng.random() < 0.2)
            rng.shuffle(kids)
            if rng.random() < 0.9 or i == 0:
                tree[str(i)] = node(kids)
        trees.append(tree)
    df = spark.createDataFrame([(i, "q", "p", t) for i, t in enumerate(trees)], "idx bigint, " + schemas.THOUGHT_TREE)
    got = {i: [] for i in range(len(trees))}
    for r in corpus.tree_paths(df).orderBy("idx", "path_no").collect():
        got[r.idx].append(r.ids)
    want = {i: brute_paths(t) for i, t in enumerate(trees)}
    assert got == want
    by_level = corpus.tree_paths_by_level(corpus.tree_nodes(df)).orderBy("idx", "ordinals").collect()
    assert {i: [r.ids for r in by_level if r.idx == i] for i in want} == want
    by_jumps = corpus.tree_paths_by_jumps(corpus.tree_nodes(df)).orderBy("idx", "ordinals").collect()
    assert {i: [r.ids for r in by_jumps if r.idx == i] for i in want} == want
    assert [(r.idx, r.ordinals) for r in by_jumps] == [(r.idx, r.ordinals) for r in by_level]


def test_a_long_chain_takes_few_jumps(spark, monkeypatch):
    n, rounds = 10_000, []
    # a chain with a leaf at the side of every thousandth node, and a cycle that the root doesn't lead to
    chain = spark.range(n).select(
        F.lit(1).alias("idx"), F.col("id").cast("string").alias("node_id"),
        F.when(F.col("id") == n - 1, F.array().cast("array<string>")).when(F.col("id") % 1000 == 0, F.array(
            F.concat(F.lit("s"), F.col("id").cast("string")), (F.col("id") + 1).cast("string"))).otherwise(
            F.array((F.col("id") + 1).cast("string"))).alias("children"))
    others = spark.createDataFrame(
        [(1, f"s{i}", []) for i in range(0, n, 1000)] + [(1, "c1", ["c2"]), (1, "c2", ["c1", "c3"]), (1, "c3", [])],
        "idx int, node_id string, children array<string>")
    nodes = chain.unionByName(others).withColumns(
        {"thought": F.lit("t"), "reasoning": F.lit("r"), "score": F.lit(0.5)})

    def counted(df, name):
        rounds.append(name)
        return written(df, name)

    monkeypatch.setattr(corpus, "written", counted)
    found = {r.ids[-1]: r for r in corpus.tree_paths_by_jumps(nodes).select("ids", "ordinals").collect()}
    assert rounds.count("jumps") <= 14 and len(rounds) < 50
    assert len(found) == 11
    assert found[str(n - 1)].ids == [str(i) for i in range(1, n)]
    assert found[str(n - 1)].ordinals == [int(i % 1000 == 0) for i in range(n - 1)]
    assert found["s3000"].ids == [str(i) for i in range(1, 3001)] + ["s3000"] and found["s3000"].ordinals[-1] == 0


def test_paths_by_level_equal_paths_in_the_row(spark):
    records = [
        {"0": node([2, 1]), "1": node([3, 9]), "2": node([3], thought=None), "3": node([], "x", None, None)},
        {"0": node([1]), "1": node([2, 3]), "2": node([1, 0]), "3": node(score=0.5)},
        {"0": node([])}, {"1": node()}, {"0": node([5])},
    ]
    df = spark.createDataFrame([(i, "q", "p", t) for i, t in enumerate(records)], "idx bigint, " + schemas.THOUGHT_TREE)
    fields = ["idx", "ids", "process", "label", "final_score"]
    in_row = corpus.tree_paths(df).orderBy("idx", "path_no").select(fields).collect()
    by_level = corpus.tree_paths_by_level(corpus.tree_nodes(df)).orderBy("idx", "ordinals").select(fields).collect()
    assert in_row == by_level and len(in_row) == 3
    assert corpus.tree_paths_by_jumps(corpus.tree_nodes(df)).orderBy("idx", "ordinals").select(fields).collect() == in_row
    for empty in (df.where("idx > 1"), df.limit(0)):
        assert corpus.tree_paths_by_level(corpus.tree_nodes(empty)).count() == 0
        assert corpus.tree_paths_by_jumps(corpus.tree_nodes(empty)).count() == 0


def test_clean_process(spark):
    def labels(n, last="Final Answer Node."):
        return [(f"c{i}", 0.0) for i in range(n - 1)] + [(last, 0.0)] if n else []

    rows = [
        (1, f"Step 5: a{SEP}Step 6: b{SEP}Step 60: c", labels(7), "0.5"),
        (2, f"Step 1: a{SEP}Step 60: c", labels(5), "1"),
        (3, "Step 1: a", labels(1), None),
        (4, "Step 1: Step 6", labels(2, "other"), "1e-5"),
        (5, "", [], "0.1"),
        (6, "x", labels(2), "1e-5"),
    ]
    df = spark.createDataFrame([(i, "q", "p", t, lab, s) for i, t, lab, s in rows], schemas.PROCESS)
    got = {r.idx: (r.process, [x.critique for x in r.label]) for r in corpus.clean_process(df).collect()}
    assert got == {
        1: ("Step 5: a", ["c0", "c1", "c2", "c3", "c4"]),
        2: ("Step 1: a", ["c0", "c1", "c2", "c3", "Final Answer Node.\n\n**SCORE:** 1"]),
        3: ("Step 1: a", ["Final Answer Node.\n\n**SCORE:** "]),
        4: ("Step 1: Step 6", ["c0", "other"]),
        5: ("", []),
        6: ("x", ["c0", "Final Answer Node.\n\n**SCORE:** 1e-05"]),
    }


def test_responses(spark):
    def response(n):
        return [f"Step {i + 1}: s{i}" for i in range(n)]

    rows = [("u", "q", [(response(5), "old", 0.5), (response(7), "old", 0.9), (response(6), None, None),
                        ([], "none", 0.9), (None, "n", None)])]
    df = spark.createDataFrame(rows, schemas.RESPONSES)
    capped = df.select(corpus.cap_responses(F.col("response_list")).alias("r")).first().r
    assert [(None if x.response is None else len(x.response), x.answer) for x in capped] == [
        (5, "old"), (5, "s4"), (5, "s4"), (0, "none"), (None, "n")]
    best = df.select(corpus.best_response(F.col("response_list")).alias("b")).first().b
    assert (best.position, len(best.response)) == (1, 7)
    out = corpus.explode_responses(df).orderBy("response_no").collect()
    assert len(out) == 5 and out[0].input == "user_profile: u\ninitial_question: q"
    assert out[0].output == "\n".join(response(5))


def test_step_examples(spark):
    rows = [
        (1, "q", "p", f"a{SEP} \n{SEP}　b {SEP}", [("c1", 0.1), ("c2", 0.2)], "1"),
        (2, "q", "p", f"a{SEP}b", [("c1", 0.1)], "1"),
    ]
    df = spark.createDataFrame(rows, schemas.PROCESS)
    got = [(r.idx, r.step_no, r.context, r.step, r.critique)
           for r in corpus.step_examples(df).orderBy("idx", "step_no").collect()]
    assert got == [(1, 0, "", "a", "c1"), (1, 1, f"a{SEP}\n", "b", "c2")]


def split_of(spark, sizes, **options):
    rows = [(f, p) for f, n in sizes.items() for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "file string, position bigint")
    return corpus.seeded_split(df, "file", "position", **options).collect()


def brute_split(sizes):
    import hashlib

    train = set()
    for f, n in sizes.items():
        order = sorted(range(1, n + 1), key=lambda p: (hashlib.md5(f"{p}|42".encode()).hexdigest(), p))
        train |= {(f, p) for p in order[:math.floor(n * 0.9)]}
    return train


SIZES = {"hot": 1200, "same1": 137, "same2": 137, "one": 1, "ten": 10, "two": 2}


def check_split(rows):
    assert len(rows) == sum(SIZES.values())
    train = {(r.file, r.position) for r in rows if r.split == "train"}
    assert train == brute_split(SIZES)
    same = [{p for f, p in train if f == name} for name in ("same1", "same2")]
    assert same[0] == same[1]


def test_seeded_split(spark):
    check_split(split_of(spark, SIZES))
    check_split(split_of(spark, SIZES, prefix=1))


def test_running_sum_with_a_hot_group(spark):
    rows = [("hot", i * 3, i % 5) for i in range(2000)] + [("b", i, 1) for i in range(7)] + [
        ("c", -5, 2), ("c", 900, 3)] + [("sparse", hash((i, "x")) % 10**15, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint")
    got = {(r.g, r.o): r.total for r in skew.running_sum(df, ["g"], "o", F.col("v"), "total").collect()}
    want, sums = {}, {}
    for g, o, v in sorted(rows):
        sums[g] = sums.get(g, 0) + v
        want[g, o] = sums[g]
    assert got == want


def test_deep_and_wide_trees(spark):
    """A chain of 200 levels, and one tree of 8000 nodes, in the row and level by level."""
    import time
    chain = {str(i): ([str(i + 1)] if i < 200 else [], f"t{i}", "r", 0.5) for i in range(201)}
    wide = {str(i): ([str(c) for c in range(3 * i + 1, 3 * i + 4) if c < 8000], f"t{i}", "r", 1.0) for i in range(8000)}
    for tree, leaves in ((chain, 1), (wide, 8000 - 2666 - 1)):
        df = spark.createDataFrame([(1, "q", "p", tree)], "idx bigint, initial_question string, user_profile string, "
                                   "thought_tree map<string,struct<children:array<string>,thought:string,reasoning:string,score:double>>")
        start = time.time()
        got = corpus.tree_paths(df).select("ids", "process").collect()
        assert time.time() - start < 20
        assert len(got) >= leaves
        if tree is chain:
            assert len(got) == 1 and got[0].ids == [str(i) for i in range(1, 201)]
            assert got[0].process.endswith("Step 200: t200")
        else:
            childless = {i for i, n in tree.items() if not n[0]}
            assert {r.ids[-1] for r in got} == childless and len(got) == len(childless)


def test_transcripts(spark):
    turns = spark.createDataFrame([(1, 2, "ASSISTANT", "b"), (1, 1, "user", "a"), (2, 1, "user", None), (1, 10, "user", "c")],
                                  "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r.transcript for r in corpus.transcripts(turns.repartition(3)).collect()}
    assert got == {1: "User: a\n\nAssistant: b\n\nUser: c\n\n", 2: ""}
