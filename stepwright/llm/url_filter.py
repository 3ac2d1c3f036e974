"""URL filter: rules by host and path, and for what they leave open a naive Bayes model over split host names.

Host names run words together. Their letter runs are split by a unigram model: of
all ways to cut a name into words the one whose words' shares in a word count
multiply to the most (Viterbi); a piece that is no word has 10 / (N * 10^letters).
The parts of all different names are joined to the counted words, whatever their
number; each name is then solved on its own. Words of hosts and tokens of paths of
the urls that a rule decides are counted by verdict, and a multinomial naive Bayes
model with one added to each count scores the rest. Words or tokens that no
decided url has don't count. Costs and weights are whole millionths, so that sums
don't depend on their order.

Nulls and odd rows: a null url, or one without ://, has an empty host and path,
no rule, and the verdict that the prior gives. Null and repeated ids are kept,
each row is judged by itself. Runs of letters or digits longer than NAME are taken
in pieces of that many. A score of 0 is `allow`, also where nothing is decided by
a rule; an empty table gives no rows. Only page_id and url are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import join_hot
from stepwright.sources.workspace import written

NAME = 63   # letters of a name at most: a label of a host has no more
WORD = 24   # letters of a word in the count at most
MILLION = 1_000_000

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKENS = rf"\p{{L}}{{1,{NAME}}}|\p{{N}}{{1,{NAME}}}"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*+", 0), _CAPITALS, _SMALL)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, else null; of equally long ones the longer host's."""
    fitting = [
        F.when(((host == F.lit(h)) | host.endswith(F.lit("." + h))) & path.startswith(F.lit(p)),
               F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))]
    return F.coalesce(*fitting)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all lower-cased letter runs of `text` that are no longer than a word may be."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)
    return texts.select(F.explode(runs).alias("word")).where(F.length("word") <= WORD).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"))


def best_split(name: str, known: dict[tuple[int, int], int], unknown: list[int]) -> list[str]:
    """The cheapest pieces; then the fewest; then, from the end, the longest.

    `known` has the cost of the words at (first letter, letters), `unknown` that of a
    piece by its letters.
    """
    best = [(0, 0, 0)]
    for end in range(1, len(name) + 1):
        best.append(min(
            (best[end - size][0] + min(unknown[size], known.get((end - size, size), unknown[size])),
             best[end - size][1] + 1, -size) for size in range(1, end + 1)))
    pieces, end = [], len(name)
    while end:
        size = -best[end][2]
        pieces.append(name[end - size:end])
        end -= size
    return pieces[::-1]


def split_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, pieces) of different names, by the counts of words (word, n)."""
    names, words = written(names, "names"), written(words, "words")
    total = max(1, words.agg(F.sum("n")).first()[0] or 0)
    letters = F.length("name")
    parts = names.select("name", F.explode(F.sequence(F.lit(1), letters)).alias("first")).select(
        "name", "first", F.explode(F.sequence(F.lit(1), F.least(F.lit(WORD), letters - F.col("first") + 1))).alias("size"))
    parts = written(parts.select("name", "first", "size", F.expr("substring(name, first, size)").alias("word")), "parts")
    cost = F.round((math.log(total) - F.log("n")) * MILLION).cast("bigint")
    known = join_hot(parts, words.select("word", cost.alias("cost")), "word").groupBy("name").agg(
        F.collect_list(F.struct(F.col("first"), F.col("size"), F.col("cost"))).alias("known"))
    # of a name of 63 letters 1,224 parts at most
    unknown = [round(MILLION * (math.log(total) + (size - 1) * math.log(10))) for size in range(NAME + 1)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [best_split(name, {(k["first"] - 1, k["size"]): k["cost"] for k in known or ()}, unknown)
                     for name, known in zip(b["name"].to_pylist(), b["known"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["name"], pa.array(found, pa.list_(pa.string()))],
                                             names=["name", "pieces"])

    return names.join(known, "name", "left").select("name", "known").mapInArrow(
        solve, "name string, pieces array<string>")


def _log_ratio(good: Column, bad: Column, of_good: int, of_bad: int) -> Column:
    return F.round(MILLION * (F.log(good / F.lit(float(of_good))) - F.log(bad / F.lit(float(of_bad))))).cast("bigint")


def _weights(decided: DataFrame, names: DataFrame) -> DataFrame:
    """(key, weight) of host names and path tokens that have a word or token seen in decided urls."""
    counts = written(decided.select(F.explode("keys").alias("key"), (F.col("verdict") == "allow").alias("good")).groupBy(
        "key").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "key-counts")
    of_names = counts.where("key like 'n:%'").withColumn("name", F.expr("substring(key, 3)")).join(names, "name")
    pieces = of_names.select(F.explode("pieces").alias("piece"), "good", "bad").select(
        F.concat(F.lit("h:"), "piece").alias("token"), "good", "bad")
    tokens = pieces.unionByName(counts.where("key like 'p:%'").withColumnRenamed("key", "token")).groupBy("token").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    tokens = written(tokens, "token-counts")
    size, good, bad = tokens.agg(F.count(F.lit(1)), F.sum("good"), F.sum("bad")).first()
    model = written(tokens.select("token", _log_ratio(
        F.col("good") + 1, F.col("bad") + 1, (good or 0) + size, (bad or 0) + size).alias("weight")), "token-weights")
    uses = written(names.select("name", F.explode("pieces").alias("piece")).select(
        "name", F.concat(F.lit("h:"), "piece").alias("token")), "name-words")
    of_hosts = join_hot(uses, model, "token").groupBy(F.concat(F.lit("n:"), "name").alias("key")).agg(
        F.sum("weight").alias("weight"))
    return of_hosts.unionByName(model.where("token like 'p:%'").withColumnRenamed("token", "key"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], words: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score, in millionths, is null where a rule decides."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))

    def keyed(kind: str, column: str) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(F.col(column)), F.lit(_TOKENS), 0),
                           lambda t: F.concat(F.lit(kind), t))

    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "*", rule_of(F.col("host"), F.col("path"), rules).alias("found"),
        F.concat(keyed("n:", "host"), keyed("p:", "path")).alias("keys"))
    rows = written(rows.select("row", "page_id", "host", "path", "found.rule", "found.verdict", "keys"), "urls")
    names = rows.select(F.explode("keys").alias("key")).where("key like 'n:%'").select(
        F.expr("substring(key, 3)").alias("name")).distinct()
    names = written(split_names(names, words), "name-pieces")
    decided, open_ = rows.where("rule is not null"), rows.where("rule is null")
    good, bad = decided.agg(F.count_if(F.col("verdict") == "allow"), F.count_if(F.col("verdict") == "block")).first()
    prior = round(MILLION * (math.log(good + 1) - math.log(bad + 1)))
    weights = written(_weights(decided, names), "key-weights")
    uses = written(open_.select("row", F.explode("keys").alias("key")), "open-keys")
    scores = join_hot(uses, weights, "key").groupBy("row").agg(F.sum("weight").alias("score"))
    score = F.when(F.col("rule").isNull(), F.coalesce("score", F.lit(0)) + prior)
    return rows.join(scores, "row", "left").withColumn("score", score).select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("score") >= 0, "allow").otherwise("block")).alias("verdict"), "score")
