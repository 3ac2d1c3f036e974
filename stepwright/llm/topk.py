"""Exact top-k search by tiled matrix products.

Vectors become whole numbers, floor(scale * x), and are packed into blocks of
rows. The table's blocks are dealt into shards, the query rows into groups, both
of bounded size, so that a task holds one shard and one group: the product of the
two, tile by tile, keeps the k best of each query. The lists of a query are then
merged as a tree, a branch of shards at a time. Every query meets every row of
its length; nothing is pruned, so the result is exact.

Products are done in double precision where their sums stay below 2^53, else in
whole numbers of any size; scores beyond a long are held at its ends.

Nulls and odd rows: a null vector, one with a null or non-finite component, or
one without id takes no part. Vectors are compared with those of equal length
only. A row is no candidate of its own; another row of the same id is. Ties go
to the smaller id. With fewer than k candidates all are returned. An empty table
gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwright.sources.workspace import written

BLOCK_ROWS = 512
SHARD_ROWS = 1 << 16   # rows of the table that a task holds
GROUP_ROWS = 1 << 13   # queries that a task holds
BRANCH = 16            # shards whose lists are merged first

BLOCK = "is_query boolean, length int, n int, kind string, row_ids binary, vec_ids binary, numbers binary"
_KINDS = ((2**15, "<i2"), (2**31, "<i4"), (2**53, "<f8"))


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x.astype(np.float64))


def _block(is_query: bool, length: int, rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    most = float(np.abs(numbers).max(initial=0))
    kind = next((k for bound, k in _KINDS if most < bound), "<f8")
    values = [is_query, length, len(rows), kind, rows.astype("<i8").tobytes(), ids.astype("<i8").tobytes(),
              numbers.astype(kind).tobytes()]
    types = [pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)],
                                      names=[c.split()[0] for c in BLOCK.split(", ")])


def pack(vectors: DataFrame, queries: str, scale: int) -> DataFrame:
    """Blocks of the rows that take part, and again of those that are queries."""
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("embedding")).where(fit).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.expr(queries).alias("q"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], list] = {}

        def flush(key: tuple[bool, int]) -> pa.RecordBatch:
            ids, own, numbers = zip(*held.pop(key))
            return _block(*key, np.array(ids, np.int64), np.array(own, np.int64), np.stack(numbers))

        for b in batches:
            lists = b["embedding"]
            at = lists.offsets.to_numpy()
            numbers = quantise(lists.values.to_numpy(zero_copy_only=False), scale)
            for i, (row, own, q) in enumerate(zip(b["row"].to_pylist(), b["vec_id"].to_pylist(), b["q"].to_pylist())):
                vector = numbers[at[i]:at[i + 1]]
                for key in ((False, len(vector)), (True, len(vector)))[:1 + bool(q)]:
                    held.setdefault(key, []).append((row, own, vector))
                    if len(held[key]) == BLOCK_ROWS:
                        yield flush(key)
        for key in list(held):
            yield flush(key)

    return rows.mapInArrow(blocks, BLOCK)


def _matrix(table: pa.Table, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, length = table["n"][i].as_py(), table["length"][i].as_py()
    raw = np.frombuffer(table["numbers"][i].as_py(), table["kind"][i].as_py()).reshape(n, length)
    return (np.frombuffer(table["row_ids"][i].as_py(), "<i8"), np.frombuffer(table["vec_ids"][i].as_py(), "<i8"),
            raw.astype(np.float64))


def products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as long."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(s).max(initial=0)) * q.shape[1] < 2**53:
        return (q @ s.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    found = (whole(q) if q.size else q.astype(object)) @ (whole(s) if s.size else s.astype(object)).T
    return np.clip(found, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best columns of each row: higher scores, then smaller ids."""
    if scores.shape[1] > 4 * k:
        # every column that reaches the k-th best score stays in, so ties are settled by the id below
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        keep = scores >= floor
        width = int(keep.sum(axis=1).max())
        order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
        ids, rows = np.take_along_axis(ids, order, 1), np.take_along_axis(rows, order, 1)
        kept = np.take_along_axis(keep, order, 1)
        scores = np.where(kept, np.take_along_axis(scores, order, 1), np.iinfo(np.int64).min)
        ids, rows = np.where(kept, ids, np.iinfo(np.int64).max), np.where(kept, rows, -1)
    order = np.lexsort((rows, ids, ~scores), axis=1)[:, :k]  # ~x reverses the order without overflow
    return tuple(np.take_along_axis(x, order, 1) for x in (scores, ids, rows))


def top_k(vectors: DataFrame, k: int, queries: str, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row for which the SQL condition `queries` holds."""
    blocks = written(pack(vectors, queries, scale), "blocks")
    n = {r[0]: r[1] for r in blocks.groupBy("is_query").agg(F.sum("n")).collect()}
    shards = max(1, -(-n.get(False, 0) // SHARD_ROWS), 2 * blocks.sparkSession.sparkContext.defaultParallelism)
    groups = max(1, -(-n.get(True, 0) // GROUP_ROWS))

    def dealt(count: int):
        return F.pmod(F.xxhash64("row_ids"), F.lit(count)).cast("int")

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    table = blocks.where("not is_query").withColumn("shard", dealt(shards)).withColumn("group", every(groups))
    asked = blocks.where("is_query").withColumn("group", dealt(groups)).withColumn("shard", every(shards))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(right.num_rows):
            q_rows, q_ids, q = _matrix(right, i)
            best = None
            for j in range(left.num_rows):
                s_rows, s_ids, s = _matrix(left, j)
                scores = products(q, s)
                ids, rows = np.broadcast_to(s_ids, scores.shape), np.broadcast_to(s_rows, scores.shape)
                own = q_rows[:, None] == rows
                if own.any():  # a row is dropped after one more was kept in its place
                    scores = np.where(own, np.iinfo(np.int64).min, scores)
                    rows = np.where(own, -1, rows)
                    ids = np.where(own, np.iinfo(np.int64).max, ids)
                if best is not None:
                    scores, ids, rows = (np.concatenate(x, axis=1) for x in zip(best, (scores, ids, rows)))
                best = _best(scores, ids, rows, k)
            if best is not None:
                scores, ids, rows = best
                real = rows >= 0
                shape = scores.shape
                out.append(pa.table({
                    "query_row": np.broadcast_to(q_rows[:, None], shape)[real],
                    "query_id": np.broadcast_to(q_ids[:, None], shape)[real], "row": rows[real],
                    "vec_id": ids[real], "score": scores[real],
                    "branch": np.full(int(real.sum()), left["shard"][0].as_py() // BRANCH, np.int32)}))
        schema = pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "row", "vec_id", "score")]
                           + [("branch", pa.int32())])
        return pa.concat_tables(out) if out else schema.empty_table()

    keys = ["length", "shard", "group"]
    lists = table.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        search, "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint, branch int")

    def merged(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = merged(lists, "query_row", "branch").drop("rank")
    return merged(first, "query_row").select("query_id", "rank", "vec_id", "score")
