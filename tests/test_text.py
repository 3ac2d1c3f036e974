"""Golden cases of the text expressions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stepwright.functions import prompts, steps, text, tokens


def apply(spark, expression, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_strip_is_unicode_aware(spark):
    cases = ["  a b ", "　x\xa0", "\x1c\t\n y\x1f", "", " \r\n\x0b", "z"]
    assert apply(spark, text.strip, cases) == [c.strip() for c in cases]


def test_words_split_like_python(spark):
    every = [f"a{chr(c)}b" for c in [*range(1, 0x3100), 0xFEFF, 0x1F600] if not 0xD800 <= c < 0xE000]
    assert apply(spark, text.words, every) == [c.split() for c in every]
    assert apply(spark, text.strip, [c[1:-1] for c in every]) == [c[1:-1].strip() for c in every]
    cases = ["a  b\nc", " lead", "", " \t", "x y　z"]
    assert apply(spark, text.words, cases) == [c.split() for c in cases]


@pytest.mark.parametrize("raw, answer", [
    ("<answer> Yes </answer>", "Yes"),
    ("<ANSWER>no</Answer>", "no"),
    ("no tags", ""),
    ("<answer>runs on\nto the end\n", "runs on\nto the end"),
    ("<answer>one</answer><answer>two</answer>", "one"),
    ("<answer><b>Yes</b>, a &lt; b &amp;amp; c</answer>", "Yes, a < b &amp; c"),
    ("<explanation>x</explanation>\n<answer id='1'>Yes</answer >", "Yes"),
    ("<answers>No</answers>", ""),
])
def test_tag_text(spark, raw, answer):
    assert apply(spark, lambda c: text.tag_text(c, "answer"), [raw]) == [answer]


def test_parse_score_takes_the_first_marker(spark):
    cases = {"**SCORE:** 0.5 **SCORE:** 1": 0.5, "**score:**-.75": -0.75, "**SCORE:** +2": 2.0,
             "**SCORE:** high": 0.0, "SCORE: 1": 0.0, "": 0.0, "**SCORE:** 1.": 1.0}
    assert apply(spark, text.parse_score, list(cases)) == list(cases.values())
    assert apply(spark, text.parse_score, [None]) == [0.0]


def test_format_score_prints_like_json_tools(spark):
    numbers = [0.5, -1.0, 1e-5, 0.0005, 0.00012345, 1234567.0, 12345678.5, 1e16, -2.5e-7, 0.0, 1e22, 123456789012.0]
    assert apply(spark, text.format_score, numbers, "double") == [repr(n) for n in numbers]
    raw = ["1", "-3", "0.50", "1e-5", None]
    printed = [str(json.loads(r)) if r else "" for r in raw]
    assert apply(spark, lambda c: text.format_score(c, is_text=True), raw) == printed


def test_collapse_tokens_quotes_the_tokens(spark):
    got = apply(spark, lambda c: text.collapse_tokens(c, "<|p.|>", "$img$"),
                ["<|p.|><|p.|>a<|p.|>$img$$img$b$img$", "<|pX|>a"])
    assert got == ["a<|p.|>$img$b$img$", "<|pX|>a"]


def test_fill_does_not_search_filled_text(spark):
    df = spark.createDataFrame([("{question}", "why {preference}?")], "p string, q string")
    prompt = prompts.fill("P={preference} Q={question}{other}", preference=F.col("p"), question=F.col("q"))
    assert df.select(prompt).first()[0] == "P={question} Q=why {preference}?{other}"


def test_fill_rubric_searches_filled_text_in_order(spark):
    df = spark.createDataFrame([
        ("acknow", "{question}|{end_generation}"), ("violate", "{preference}|{question}|{end_generation}"),
        ("hallucinate", "{preference}|{assistant_restatement}|{question}"), ("helpful", "{question}|{end_generation}"),
    ], "metric string, t string")
    filled = prompts.fill_rubric(F.col("t"), F.col("metric"), F.lit("P{question}"), F.lit("Q"),
                                 F.lit("R{question}"), F.lit("S"))
    got = {r[0]: r[1] for r in df.select("metric", filled).collect()}
    assert got == {"acknow": "Q|RQ", "violate": "PQ|Q|R{question}", "hallucinate": "P{question}|S|{question}",
                   "helpful": "Q|R{question}"}


def test_chat_text_and_loss_span(spark):
    df = spark.range(1).select(F.array(
        prompts.message("user", F.lit("hi")), prompts.message("assistant", F.lit("yo"))).alias("m"))
    row = df.select(prompts.chat_text(F.col("m")).alias("t"),
                    prompts.chat_text(F.slice("m", 1, 1), generation_prompt=True).alias("g"),
                    prompts.loss_span(prompts.chat_text(F.col("m"))).alias("s"),
                    prompts.loss_span(F.lit("none")).alias("n")).first()
    assert row.t == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert row.g == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    assert (row.s, row.n) == ("yo<|im_end|>\n", None)


COMPLETIONS = {
    "Step 1: a Step 1: dup Step 3: skip Step 2: b Step 9: tail Step 3: c Step 7: z":
        ["Step 1: a Step 1: dup Step 3: skip", "Step 2: b Step 9: tail", "Step 3: c"],
    "Step 2: q Step 1: w": ["Step 1: w"],
    "pre Step 3: x Step 4: y": ["Step 3: x", "Step 4: y"],
    "  plain text ": ["plain text"],
    "": [""],
    "Step 1: a Step 2: b Step 3: c Step 4: d Step 5: e Step 6: f":
        ["Step 1: a", "Step 2: b", "Step 3: c", "Step 4: d", "Step 5: e"],
    "Step 7: a Step 7: b Step 7: c Step 7: d Step 7: e Step 7: f":
        ["Step 7: a", "Step 7: b", "Step 7: c", "Step 7: d", "Step 7: e"],
    "Step 01: a Step 2:b": ["Step 01: a", "Step 2:b"],
    "Step 99999999999999999999999999999999999999999999: a": ["Step 99999999999999999999999999999999999999999999: a"],
}


def test_completion_steps(spark):
    df = spark.createDataFrame([(t,) for t in COMPLETIONS], "t string")
    got = {r.t: r.steps for r in steps.with_completion_steps(df, "t").collect()}
    assert got == COMPLETIONS


def expected_steps(completion):
    """Brute force: mark, choose, cut."""
    marks, at = [], 0
    for piece in completion.split("|"):
        if piece.startswith("Step "):
            marks.append((int(piece.split()[1].rstrip(":")), at))
        at += len(piece)
    joined = completion.replace("|", "")
    if not marks:
        return [joined.strip()]
    chosen, want = [], 1
    for i, (number, _) in enumerate(marks):
        if number == want and want <= 5:
            chosen.append(i)
            want += 1
    chosen = chosen or list(range(min(5, len(marks))))
    ends = [marks[c][1] for c in chosen[1:]]
    ends.append(marks[chosen[-1] + 1][1] if chosen[-1] + 1 < len(marks) else len(joined))
    return [joined[marks[c][1]:e].strip() for c, e in zip(chosen, ends)]


def test_completion_steps_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["|".join(rng.choice(["Step %d: " % rng.randint(1, 7), "word ", "\n\n", "Step x: "])
                      for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts = [t.replace("Step x", "Stop x") for t in texts]
    df = spark.createDataFrame([(t, t.replace("|", "")) for t in set(texts)], "k string, t string")
    for row in steps.with_completion_steps(df, "t").collect():
        assert row.steps == expected_steps(row.k), row.k


def test_find_tokens_against_brute_force(spark):
    def first(hay, needle):
        if not needle:
            return 0
        spots = [i for i in range(len(hay) - len(needle) + 1) if hay[i:i + len(needle)] == needle]
        return spots[0] if spots else -1

    rng = random.Random(3)
    pairs = [([rng.choice([1, 11, 2]) for _ in range(rng.randint(0, 9))],
              [rng.choice([1, 11, 2]) for _ in range(rng.randint(0, 3))]) for _ in range(400)]
    df = spark.createDataFrame(pairs, "h array<int>, n array<int>")
    for row in df.select("h", "n", tokens.find_tokens(F.col("h"), F.col("n")).alias("at")).collect():
        assert row["at"] == first(row.h, row.n), row


def test_masks_and_tail(spark):
    df = spark.createDataFrame([(["a", "E", "b", "E"],), (["E"],), (["a", "b"],), ([],)], "t array<string>")
    eos = F.lit("E")
    mask = tokens.eos_mask(F.col("t"), eos)
    rows = df.select(mask.alias("m"), tokens.mask_truncated(mask, F.col("t"), eos).alias("z"),
                     tokens.tail(F.col("t"), 3).alias("tail"),
                     tokens.tail(F.col("t"), 2, ["a"]).alias("kept")).collect()
    assert [r.m for r in rows] == [[1, 1, 0, 0], [1], [1, 1], []]
    assert [r.z for r in rows] == [[1, 1, 0, 0], [1], [0, 0], []]
    assert [r.tail for r in rows] == [["E", "b", "E"], ["E"], ["a", "b"], []]
    assert [r.kept for r in rows] == [["a", "E"], ["E"], ["a", "b"], []]


def test_score_after_unicode_space(spark):
    for gap in ("\u00a0", "\u3000", "\u2009 ", "\x1c", "\x85", "\n\t"):
        assert one(spark, text.parse_score, f"**SCORE:**{gap}0.5") == 0.5


def test_character_references(spark):
    cases = {
        "a &amp;lt; b": "a &lt; b", "&apos;x&#x27;&#39;": "'x''", "&nbsp;": "\u00a0", "&#8364;&#X20AC;": "€€",
        "&#128512;!": "\U0001F600!", "&unknown; & &;": "&unknown; & &;", "&#xD800;&#0;&#1114112;": "\ufffd\ufffd\ufffd",
        "no reference": "no reference", "&lt;b&gt;": "<b>", "tail &": "tail &", "&eacute;t&eacute; &mdash; &hellip;": "été — …"}
    for raw, wanted in cases.items():
        assert one(spark, text.unescape, raw) == wanted, raw
    assert one(spark, lambda c: text.tag_text(c, "preference"), "<preference>tea &#x26; &quot;milk&quot;</preference>") \
        == 'tea & "milk"'


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).first().r


def test_tag_text_looks_for_other_tags_only_where_there_are_any(spark):
    """other tags were searched for by a pattern in every text."""
    texts = ["a", " a ", " a\t", "a <b>c</b> ", "<b> </b>", "", "  ", "&nbsp;a&#9;", "1 < 2", " é ", "x &amp; y\n"]
    rows = spark.createDataFrame([(f"<t>{t}</t> more",) for t in texts], "raw string")
    found = rows.select(text.tag_text(F.col("raw"), "t").alias("t"))
    assert [r.t for r in found.collect()] == ["a", "a", "a", "a c", "", "", "", "a", "1 < 2", "é", "x & y"]
    plan = found._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("contains(") == 2  # for tags, and for references
