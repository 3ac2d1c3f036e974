"""Token counts through a digest cache.

The cache is a Parquet table of (content, tokenizer, n_tokens): the digest of a
normalised text, the digest of a tokenizer's file, and the count, each pair of
digests once: Spark commits an append as a whole, and there is to be one writer
at a time. Documents are joined to it by both digests; of the texts not found,
one copy each is encoded, and their counts are appended. Normalising must not
change the count, so the default only makes a null text empty; a tokenizer that
folds case may bring its own expression.

Nulls and odd rows: a null text counts as the empty text (0 tokens, 0 bytes); a
null id is kept; repeated rows each get a row. An empty table gives no rows and
leaves the cache as it is. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.llm.tokens import encoder, version
from stepwright.sources.workspace import written

MAP_BITS = 24

CACHE = "content binary, tokenizer string, n_tokens bigint"


def null_to_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer version; none if nothing was stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "content binary, n_tokens bigint")
    return spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer).drop("tokenizer")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _slot(content: Column, key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(content, key), 64 - MAP_BITS)


def _bit_map(slots: DataFrame) -> np.ndarray | None:
    """Which values of `slot` there are, or None without any; what reaches the driver is the map, in words."""
    found = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    if not found.num_rows:
        return None
    words = np.zeros(1 << (MAP_BITS - 6), np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words


def encode_misses(texts: DataFrame, path: str, words: np.ndarray) -> DataFrame:
    """(content, n_tokens) of the rows (content, slot, text) whose slot is in the map, each content once in a task."""
    held = words.tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little").view(bool)
        tokens, seen = encoder(path), set()
        for b in batches:
            wanted = pa.array(bits[b["slot"].to_numpy()])
            contents, counts = [], []
            for content, text in zip(b["content"].filter(wanted).to_pylist(), b["text"].filter(wanted)):
                if content not in seen:
                    seen.add(content)
                    contents.append(content)
                    counts.append(tokens.count(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(contents, pa.binary()), pa.array(counts, pa.int64())],
                                             names=["content", "n_tokens"])

    return texts.mapInArrow(count, "content binary, n_tokens bigint")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str,
                 normalise: Callable[[Column], Column] = null_to_empty) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, after adding all missing counts to the cache.

    No text is shuffled. Of the rows of each missing digest one is chosen by its id,
    over rows of digest and id that combine before they are shuffled. Texts are
    encoded by the tasks that read them, where a bit map of the chosen rows, of
    MAP_BITS bits, has theirs; what it lets through by chance is dropped, or found to
    be equal, among digests. With more misses than the map has bits it lets most
    copies through, which are then encoded once in each task. Without misses no text
    is read but to hash it. The last join moves digests, and adaptive execution
    splits the digest of a large group of copies.
    """
    spark, known = docs.sparkSession, version(tokenizer_path)
    text = normalise(F.col("text"))
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
                       _digest(text).alias("content"))
    # ids as text, so that a null id is an id like any other
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # copies combine before the join, which then has one row of each digest on either side
    missing = rows.groupBy("content").agg(F.min(key).alias("key")).join(
        read_cache(spark, cache_path, known).select("content"), "content", "left_anti")
    chosen = written(missing.select("content", _slot(F.col("content"), F.col("key")).alias("slot")), "misses")
    words = _bit_map(chosen.select("slot"))
    if words is not None:
        texts = docs.select(_digest(text).alias("content"), key.alias("key"), text.alias("text")).select(
            "content", _slot(F.col("content"), F.col("key")).alias("slot"), "text")
        counted = encode_misses(texts, tokenizer_path, words).distinct().join(
            chosen.select("content"), "content", "left_semi")
        counted.select("content", F.lit(known).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    return rows.join(read_cache(spark, cache_path, known), "content").select("doc_id", "n_bytes", "n_tokens")
