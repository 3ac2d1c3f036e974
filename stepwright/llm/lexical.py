"""Ranked lexical search: exact inner products through ball trees over sparse vectors.

Every document becomes a sparse vector of its terms' saturated frequencies, every
query one of its terms' weights; a score is their inner product in whole numbers.
Documents are dealt into shards of bounded size and queries into groups, and a
task holds one of each: it takes the documents' components on the group's terms,
joins equal vectors to one point (of whose documents the k least ids can be among
the best), and splits the points in halves between two far ones until few are
left. A ball has its points' mean, rounded to whole numbers, for a centre, and the
largest distance from it, rounded up, for a radius, so q.c + |q| * r, rounded up,
is no less than any score inside. A query takes the balls best bound first, scores
the points of a leaf exactly, and stops where no bound left reaches its k-th best
score. Some of the shards are searched first; what they give is a floor for all
others. Bounds save time only: the result is that of scoring every document.

Terms are known by 64-bit hashes. Documents keep only terms that a bit map of the
queries' terms lets through, of FILTER_BITS bits whatever their number; document
counts and lengths are of all terms.

Nulls and odd rows: a null text has no terms, and documents without terms count
nowhere. Documents of equal or null ids each take part; a null id comes before
others at equal scores. Every row of the items is a query of its own; one without
terms, or without a document that shares one, has no rows. Empty tables give no
rows. Only doc_id and text, or item_id and text, are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwright.llm.common import LOWER, SpanHash, slices, text_of
from stepwright.sources.workspace import written

FILTER_BITS = 22
SHARD_TERMS = 1 << 20   # components of documents that a task holds, about
SHARD_ROWS = 1 << 13
GROUP_TERMS = 1 << 16   # components of queries that a task holds, about, or one query
LEAF_POINTS = 48
CENTRES = 1 << 22       # numbers in all centres of a tree; leaves are larger where there are many terms
FIRST = 16              # one shard of so many is searched first

# The bytes that terms are made of, after lower-casing.
_TERM_BYTES = np.zeros(256, bool)
_TERM_BYTES[48:58] = _TERM_BYTES[97:123] = _TERM_BYTES[128:] = True

_VECTOR = "n bigint, terms array<bigint>, counts array<bigint>"


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term of the texts, in order, and the text it is in."""
    data = LOWER[data]
    here = _TERM_BYTES[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = here[1:] != here[:-1]
    edge[at] = True  # a term ends with its text
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1], cuts[1:]
    real = here[begin]
    begin, end = begin[real], end[real]
    return SpanHash(data).of(begin, end), np.searchsorted(at, begin, "right") - 1


def vectors(table: DataFrame, id_column: str, wanted: bytes | None = None) -> DataFrame:
    """(row, id, n, terms, counts): number of terms of every row's text, and its different ones that are wanted."""
    kind = dict(table.dtypes)[id_column]
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"),
                        F.col("text").cast("binary").alias("raw"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else np.unpackbits(np.frombuffer(wanted, np.uint8), bitorder="little").view(bool)
        for b in batches:
            data, at = text_of(b["raw"])
            for low, high in slices(at):
                hashes, owner = _terms(data[at[low]:at[high]], at[low:high + 1] - at[low])
                n = np.bincount(owner, minlength=high - low)
                if bits is not None:
                    keep = bits[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                    hashes, owner = hashes[keep], owner[keep]
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(hashes)))
                offsets = np.searchsorted(owner[first], np.arange(high - low + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b["row"].slice(low, high - low), b["id"].slice(low, high - low), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(hashes[first].view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))],
                    names=["row", "id", "n", "terms", "counts"])

    return rows.mapInArrow(count, f"row bigint, id {kind}, {_VECTOR}")


def _bit_map(terms: DataFrame) -> bytes:
    """Bits of the leading digits of all hashes; what reaches the driver is the map, in words."""
    slot = F.shiftrightunsigned("term", 64 - FILTER_BITS)
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in terms.groupBy(F.shiftright(slot, 6).alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")
    ).collect():
        words[r["word"]] = r["bits"]
    return words.tobytes()


class BallTree:
    """Balls around sparse points: rows of whole numbers, given by where each begins, columns and values.

    Every point has a component. Points are reordered so that each ball's are
    neighbours; `order` says which they were.
    """

    def __init__(self, at: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        points = len(at) - 1
        leaf = max(LEAF_POINTS, -(-2 * points * width // CENTRES))
        squares = values.astype(np.float64) ** 2
        self.order = np.arange(points)
        sizes = np.diff(at)
        norms = np.add.reduceat(squares, at[:-1])
        # what a dot product of so many terms may be off by, in shares of its size
        self.slack = 4 * (int(sizes.max()) + width + 8) * np.finfo(np.float64).eps
        self.low, self.high, self.left, self.right, centres, radii = [], [], [], [], [], []

        def entries(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = sizes[of]
            owner = np.repeat(np.arange(len(of)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[of], n)
            return owner, columns[place], values[place].astype(np.float64)

        def dense(point: int) -> np.ndarray:
            out = np.zeros(width)
            out[columns[at[point]:at[point + 1]]] = values[at[point]:at[point + 1]]
            return out

        open_ = [(0, points, -1, False)]
        while open_:
            low, high, parent, is_right = open_.pop()
            node, of = len(self.low), self.order[low:high]
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            owner, cols, vals = entries(of)

            def times(direction: np.ndarray) -> np.ndarray:
                return np.bincount(owner, weights=vals * direction[cols], minlength=len(of))

            centre = np.rint(np.bincount(cols, weights=vals, minlength=width) / len(of))
            size = float(centre @ centre)
            apart = norms[of] - 2 * times(centre) + size
            worst = (np.maximum(apart, 0) + self.slack * (norms[of] + size)).max()
            self.low.append(low), self.high.append(high), self.left.append(-1), self.right.append(-1)
            centres.append(centre)
            radii.append(np.sqrt(worst) * (1 + self.slack))
            if high - low > leaf:
                one = dense(of[int(apart.argmax())])
                other = dense(of[int((norms[of] - 2 * times(one)).argmax())])
                self.order[low:high] = of[np.argsort(times(other - one), kind="stable")]
                middle = (low + high) // 2
                open_ += [(middle, high, node, True), (low, middle, node, False)]
        self.centres = np.ascontiguousarray(np.stack(centres).T)  # a row for each column of the points
        self.radii = np.array(radii)
        _, self.columns, values = entries(self.order)
        self.values = values.astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(sizes[self.order])))

    def bounds(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every ball, a number no inner product with one of its points is above."""
        weights = weights.astype(np.float64)
        length = np.sqrt(weights @ weights) * (1 + self.slack)
        return (weights @ self.centres[columns] + length * self.radii) * (1 + self.slack) + 1

    def search(self, columns: np.ndarray, weights: np.ndarray, ids: list[list], k: int, floor: int) -> tuple[list, int]:
        """The k best (score, id), equal scores by id, of those that reach `floor`; and how many points were scored.

        `ids` has, for each point, its ids in order.
        """
        bounds = self.bounds(columns, weights).tolist()
        asked = np.zeros(len(self.centres), np.int64)
        asked[columns] = weights
        best: list[tuple] = []
        floor, scored = max(floor, 1), 0
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= floor:
            bound, node = heapq.heappop(heap)
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(heap, (max(bound, -bounds[child]), child))
                continue
            low, high = self.low[node], self.high[node]
            first, last = self.at[low], self.at[high]
            scores = np.add.reduceat(self.values[first:last] * asked[self.columns[first:last]], self.at[low:high] - first)
            scored += high - low
            good = np.flatnonzero(scores >= floor)
            if len(good):
                best += [(-s, i is not None, i) for p, s in zip(good.tolist(), scores[good].tolist())
                         for i in ids[self.order[low + p]]]
                best.sort()
                del best[k:]
                if len(best) == k:
                    floor = max(floor, -best[-1][0])
        return [(-s, i) for s, _, i in best], scored


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins, and all their numbers."""
    column = lists.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    at = column.offsets.to_numpy()
    return at - at[0], column.values.to_numpy()[at[0]:at[-1]]


def _tree(docs: pa.Table, vocabulary: np.ndarray, k: int) -> tuple[BallTree | None, list[list]]:
    """Tree of the documents' different vectors on the vocabulary, and each point's ids, least first."""
    at, terms = _flat(docs["terms"])
    _, counts = _flat(docs["counts"])
    owner = np.repeat(np.arange(docs.num_rows), np.diff(at))
    column = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    known = vocabulary[column] == terms
    owner, column, counts = owner[known], column[known], counts[known]
    m = docs["m"].to_numpy()[owner]
    values = 1_000_000_000 * counts // (1000 * counts + 8 * m)
    owner, column, values = owner[values > 0], column[values > 0], values[values > 0]
    at = np.searchsorted(owner, np.arange(docs.num_rows + 1))
    points: dict[tuple[bytes, bytes], list] = {}
    first = []
    for row, doc_id in enumerate(docs["id"].to_pylist()):
        low, high = at[row], at[row + 1]
        if low < high:
            ids = points.setdefault((column[low:high].tobytes(), values[low:high].tobytes()), [])
            if not ids:
                first.append(row)
            ids.append(doc_id)
    if not points:
        return None, []
    sizes = np.array([at[r + 1] - at[r] for r in first])
    place = np.concatenate([np.arange(at[r], at[r + 1]) for r in first])
    tree = BallTree(np.concatenate(([0], np.cumsum(sizes))), column[place], values[place], len(vocabulary))
    return tree, [sorted(ids, key=lambda i: (i is not None, i))[:k] for ids in points.values()]


def rank(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    asked = written(vectors(items, "item_id"), "query-terms")
    entries = asked.select("row", "id", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select(
        "row", "id", F.col("e.terms").alias("term"), F.col("e.counts").alias("times"))
    terms = entries.select("term").distinct()
    held = written(vectors(docs, "doc_id", _bit_map(terms)), "document-terms")
    # numbers of documents, of terms, of kept components and of rows that have any
    n_docs, n_terms, kept, rows = held.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0)),
        F.count_if(F.size("terms") > 0)).first()
    per_term = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    weights = per_term.join(terms, "term", "left_semi").select("term", weight.alias("w")).where("w > 0")
    queries = entries.join(weights, "term").groupBy("row").agg(
        F.first("id").alias("id"),
        F.collect_list(F.struct("term", (F.col("times") * F.col("w")).alias("weight"))).alias("e"))
    queries = written(queries.select("row", "id", F.col("e.term").alias("terms"), F.col("e.weight").alias("weights")),
                      "queries")
    asked_terms = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-kept // SHARD_TERMS), -(-rows // SHARD_ROWS))
    groups = max(1, -(-asked_terms // GROUP_TERMS))

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    m = F.expr(f"25 + (cast(n as decimal(18,0)) * cast({75 * n_docs} as decimal(20,0))) div {max(1, n_terms)}L")
    table = held.where(F.size("terms") > 0).select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "id", m.cast("bigint").alias("m"), "terms",
        "counts", every(groups).alias("group"))
    wanted = queries.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"), "row", "id", "terms",
                            "weights", every(shards).alias("shard"))
    doc_kind, item_kind = (dict(df.dtypes)["id"] for df in (held, queries))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            at, terms = _flat(right["terms"])
            _, weights = _flat(right["weights"])
            vocabulary = np.unique(terms)
            tree, ids = _tree(left, vocabulary, k)
            columns = np.searchsorted(vocabulary, terms)
            for q, (row, item, floor) in enumerate(zip(*(right[c].to_pylist() for c in ("row", "id", "floor")))):
                if tree is not None:
                    part = slice(at[q], at[q + 1])
                    best, _ = tree.search(columns[part], weights[part], ids, k, floor)
                    found += [(row, item, i, s) for s, i in best]
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.table({"row": pa.array(columns[0], pa.int64()), "item_id": pa.array(columns[1], right["id"].type),
                         "doc_id": pa.array(columns[2], left["id"].type), "score": pa.array(columns[3], pa.int64())})

    def searched(part: str, floors: DataFrame | None) -> DataFrame:
        keyed = wanted.where(part)
        keyed = keyed.withColumn("floor", F.lit(0).cast("bigint")) if floors is None else \
            keyed.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
        return table.where(part).groupBy("shard", "group").cogroup(keyed.groupBy("shard", "group")).applyInArrow(
            search, f"row bigint, item_id {item_kind}, doc_id {doc_kind}, score bigint")

    def merged(lists: DataFrame) -> DataFrame:
        order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = written(merged(searched(f"shard % {FIRST} = 0", None)), "first-lists")
    floors = first.where(F.col("rank") == k).select("row", F.col("score").alias("floor"))
    rest = searched(f"shard % {FIRST} != 0", floors)
    return merged(first.drop("rank").unionByName(rest)).select("item_id", "rank", "doc_id", "score")
