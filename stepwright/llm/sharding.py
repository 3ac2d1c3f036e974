"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Row numbers 0..N-1 follow (doc_id, text). A balanced Feistel network permutes
0..4^h - 1, the smallest such domain that holds N; numbers that land at N or
above walk on along their cycle until they fall below N, which gives a
permutation of 0..N-1. The permuted number p has shard p mod S and slot
p div S, so shards differ by one row at most, and both can be computed for any
row, or back from them, without the table.

Nulls: a null id sorts first, a null text has no bytes and crc32 0. Rows equal
in id and text are interchangeable. An empty table gives no rows. Only the id
and text columns are read; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import mix64, numbered, starts

ROUNDS = 6
OVERHEAD = 16  # bytes that each row takes besides its text


def _half_bits(total: int) -> int:
    return max(1, -(-max(total - 1, 1).bit_length() // 2))


def _rounds(seed: int) -> list[np.uint64]:
    keys = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return list(mix64(keys ^ mix64(np.array([seed % 2**64], np.uint64))[0]))


def _once(x: np.ndarray, half: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (mix64(left ^ key) & mask), left
        else:
            left, right = right, left ^ (mix64(right ^ key) & mask)
    return (left << shift) | right


def permute(numbers: np.ndarray, total: int, seed: int, back: bool = False) -> np.ndarray:
    """The place of each row number in the shuffled order; `back` undoes it."""
    half, keys = _half_bits(total), _rounds(seed)
    out = _once(np.asarray(numbers).astype(np.uint64), half, keys, back)
    walking = np.flatnonzero(out >= np.uint64(total))
    while len(walking):
        out[walking] = _once(out[walking], half, keys, back)
        walking = walking[out[walking] >= np.uint64(total)]
    return out.astype(np.int64)


def locate(numbers: np.ndarray, total: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each row number."""
    place = permute(numbers, total, seed)
    return place % shards, place // shards


def row_at(shard: np.ndarray, slot: np.ndarray, total: int, shards: int, seed: int = 0) -> np.ndarray:
    """The row number that stands at a shard's slot."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), total, seed, back=True)


def shard_rows(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot) of every row.

    Rows are numbered by a range shuffle of ids, sizes and hashes, never texts.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(raw).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_tie"))
    table, counts = numbered(rows, [F.col(c).asc_nulls_first() for c in ("doc_id", "text_crc32", "size", "_tie")],
                             "rows")
    before = starts(counts)
    total, base = before[-1], np.array(before, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = base[b["_part"].to_numpy()] + b["_pos"].to_numpy()
            shard, slot = locate(number, total, shards, seed)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["size"], b["text_crc32"], pa.array(number), pa.array(shard.astype(np.int32)),
                 pa.array(slot)], names=["doc_id", "size", "text_crc32", "row_number", "shard", "slot"])

    return table.drop("_tie").mapInArrow(
        place, "doc_id bigint, size bigint, text_crc32 bigint, row_number bigint, shard int, slot bigint")
