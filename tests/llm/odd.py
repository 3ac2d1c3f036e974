"""Documents that operators must survive, and tables of them."""

from __future__ import annotations

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))

#: id, text, lang, source, n_chars: nulls in any column, empty and blank texts, ties, repeated rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of the other animals here.", "en", "a", 5),
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of the other animals here.", "en", "a", 5),
    (2, "the quick brown fox jumps over the lazy dog and runs away from all of the other animals here.", "en", None, 5),
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (5, " \n\t ", "de", "b", 3),
    (None, "Ein ganz anderer Text, der nichts mit dem ersten zu tun hat und auch lang genug ist.", "de", "c", 1),
    (None, None, None, None, None),
    (7, "x", "fr", "c", 1),
    (7, "y", "fr", "c", 1),
    (8, "<|endoftext|> idiot 1d10t іdiot <|startoftext|>", "en", "c", 1),
    (9, "日本語のテキスト \u0000 é́", "ja", "c", 1),
    (10, LONG, "en", "d", 2),
    (11, LONG + " tail", "en", "d", 2),
    (12, "a" * 5000, "en", "d", 2),
    (-3, "123 456 !!!", "en", "d", 2),
]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Names that operators use themselves.
CLASHING = ["score", "n_hits", "rate", "p", "row", "key", "hash", "fp", "n_tokens", "start", "did", "raw", "label",
            "size", "shard", "_part", "_pos", "content", "row_key", "SCORE_"]


def odd(spark, rows=ROWS):
    """The rows, with extra columns of clashing names."""
    df = spark.createDataFrame(rows, SCHEMA)
    for i, name in enumerate(CLASHING):
        df = df.withColumn(name, df.n_chars + i)
    return df


def empty(spark):
    return odd(spark, [])


def rows_of(df, *columns):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])


def by_text(rows=ROWS):
    """Rows (id, text) with null text as empty."""
    return [(i, t or "") for i, t, *_ in rows]
