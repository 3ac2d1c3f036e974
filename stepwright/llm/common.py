"""Helpers shared by the operators: Arrow columns as numpy arrays, hashes, row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.sources.workspace import new_path, written

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
SLICE_BYTES = 1 << 20

BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """From now on, tasks hand texts to Python in batches of BATCH_BYTES.

    By Spark's default of 10,000 rows a batch holds all texts of a split, several times over in either process, and
    an executor gives such memory back late, if at all. A session that sets the bytes of a batch itself keeps its
    own. A result runs when it is written, so the setting stays.
    """
    if spark.conf.get(BATCHES, None) is None:
        spark.conf.set(BATCHES, str(BATCH_BYTES))


def text_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (n + 1 numbers). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(at: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes each, as first and last + 1; a text is never cut."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of byte spans in constant time per span, from prefix sums modulo 2^64.

    hash(span) = sum of code[byte] * BASE^place, place counted from the span's
    start, scrambled; so equal spans have equal hashes wherever they stand.
    """

    _BASE = 0x9E3779B97F4A7C15 | 1
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    _codes: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        with np.errstate(over="ignore"):
            up, down = self._table(seed, n)
            if seed not in self._codes:
                self._codes[seed] = mix64(
                    np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self._codes[seed][data] * up[:n], out=self.sums[1:])
            self.down = down

    @classmethod
    def _table(cls, seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        known = cls._powers.get(seed)
        if known is None or len(known[0]) < n + 1:
            size = max(n + 1, SLICE_BYTES + 1)
            base = (cls._BASE + 2 * seed * 0x5851F42D4C957F2D) % 2**64
            inverse = pow(base, -1, 2**64)
            with np.errstate(over="ignore"):
                rows = [np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))).cumprod(dtype=np.uint64)
                        for b in (base, inverse)]
            known = (rows[0], rows[1])
            if size <= 4 * SLICE_BYTES:
                cls._powers[seed] = known
        return known

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start]
                         + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` neighbours; log2(width) passes."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def remainder(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo `buckets`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % buckets


def numbered(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, list[int]]:
    """`df` written in global order, with `_part` and the row's number in it, `_pos`; and each part's rows.

    The numbers are global once the rows of earlier parts are added. Only the
    numbers of rows per part, one for each shuffle partition, reach the driver.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos"),
    ).write.parquet(path)
    table = spark.read.parquet(path)
    found = {r[0]: r[1] for r in table.groupBy("_part").count().collect()}
    return table, [found.get(i, 0) for i in range(max(found, default=-1) + 1)]


def starts(counts: list[int]) -> list[int]:
    """Running totals before each entry, and the total at the end."""
    out = [0]
    for n in counts:
        out.append(out[-1] + int(n))
    return out


def join_hot(rows: DataFrame, table: DataFrame, key: str, most: int = 4096) -> DataFrame:
    """Inner join of rows with a table that has one row for each key, whatever keys are frequent.

    Keys with more than 1 / most of all rows, of which there are fewer than `most`,
    are sent to the rows; all other keys are too rare to crowd a task. `rows` is
    read more than once, so it had better be a written table. Keys are to be short.
    """
    least = rows.count() // most
    frequent = rows.groupBy(key).count().where(F.col("count") > least).select(key).limit(most)
    frequent = F.broadcast(written(frequent, "frequent-keys"))
    hot = rows.join(F.broadcast(table.join(frequent, key, "left_semi")), key)
    rest = rows.join(frequent, key, "left_anti").join(table, key)
    return hot.unionByName(rest)
