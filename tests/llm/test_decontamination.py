"""Winnowed overlaps against a brute-force search of all windows."""


from pyspark.sql import functions as F

from stepwright.llm import decontamination as dec
from tests.conftest import SMALL
from tests.llm.odd import by_text, empty, odd


def brute(docs, items):
    windows = {}
    for item, text in items:
        words = dec.words_of(text or "")
        n = min(13, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault((n, *words[k:k + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        words, hit, names = dec.words_of(text), set(), set()
        for n in {w[0] for w in windows}:
            for k in range(len(words) - n + 1):
                if (n, *words[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[(n, *words[k:k + n])]
        out.append((doc_id, len(words), len(hit), sorted(str(x) for x in names if x is not None)))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def found(docs, items):
    rows = dec.find_overlaps(docs, items).select(
        "doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) for x in r])


def test_small_tables(spark, small, small_rows):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    pairs = [tuple(r) for r in items.select("item_id", "text").collect()]
    result = found(small, items)
    assert result == brute(small_rows, pairs)
    assert any(r[2] for r in result)


def test_odd_rows_and_short_items(spark, odd_docs):
    words = dec.words_of(by_text()[0][1])
    items = [(1, " ".join(words[2:17])), (1, " ".join(words[2:17])), (2, "lazy DOG"), (3, None), (4, "!!"),
             (5, "word5 and5, word6 and6 word7; and7 word8 and8 word9 and9 word10 and10 word11 and11"),
             (None, "runs away from"), (6, "aaa"), (7, " ".join(words[2:16] + ["not"])), (8, " ".join(words[3:15])),
             (9, "x"), (10, "日本語のテキスト"), (11, " ".join(["word1 and1"] * 20))]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("id", F.lit(1)).withColumn(
        "marks", F.lit(2)).withColumn("n_words", F.lit(3))
    assert found(odd_docs, table) == brute(by_text(), items)
    assert found(odd_docs, table.limit(0)) == brute(by_text(), [])
    assert found(empty(spark), table) == []


def test_shared_spans_of_every_offset(spark):
    passage = [f"p{i}" for i in range(30)]
    rows = [(n * 100 + k, " ".join([f"u{n}a{k}"] * 7 + passage[k:k + n] + [f"v{n}b{k}"] * 9), None, None, None)
            for n in (12, 13, 14, 20) for k in range(10)]
    items = [(1, "intro " + " ".join(passage) + " end")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    result = found(odd(spark, rows), table)
    assert result == brute([(r[0], r[1]) for r in rows], items)
    assert [r[2] for r in result if r[0] < 1300] == [0] * 10 and all(r[2] >= 13 for r in result if r[0] >= 1300)


def test_repeated_words(spark):
    rows = [(1, "a " * 40 + "b " * 40, None, None, None), (2, "a b " * 50, None, None, None)]
    items = [(1, "a " * 13), (2, "a b " * 7), (3, "b " * 12 + "a")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(odd(spark, rows), table) == brute([(r[0], r[1]) for r in rows], items)


