"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits, and mapped to the
point of its segments' bit counts. A changed bit moves the point by one step
along one axis, so the Manhattan distance of two points is never above the
Hamming distance of their fingerprints. The 32 axes form four blocks of eight.
Points within Manhattan distance 2 differ in two blocks at most, so they lie in
the same cell of at least one of the six grids that two blocks span: a join on
the cells finds every such pair. What it finds is held against the Manhattan
bound, then against the Hamming distance.

Equal fingerprints are one point, whatever the number of documents. In a cell of
more than CELL_POINTS points, pairs aren't formed: two fingerprints are within
two bits if and only if some value is within one bit of both, so each point of
such a cell is listed under its 65 values within one bit, and linked to the
least point of each list. That is exact, and linear in the points.

Nulls and odd rows: a null text has no words and fingerprint zero, which is
linked like any other; rows with a null id get a fingerprint, but their id is no
candidate for the smallest of a component; repeated rows each get a row. An
empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from stepwright.llm.graph import components
from stepwright.sources.workspace import written

RADIUS = 2
CELL_POINTS = 64
SEED = 42

_LOW = 0x5555555555555555  # the lower bit of each segment
_BLOCKS = [0xFFFF << (16 * i) for i in range(4)]
_GRIDS = [a | b for a, b in combinations(_BLOCKS, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority of the bits of XXH64 over the shingles of ASCII-lower-cased words; repeats count."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    begin, ends, at = [], [], 0
    for w in words:
        begin.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    hashes = b"".join([xxh64_digest(line[s:e], SEED) for s, e in zip(begin, ends[shingle - 1:])])
    n = len(words) - shingle + 1
    set_bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; the fingerprint as a signed number. The scan's tasks do it all."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py() or b"", shingle) for t in b["raw"]], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("raw")
                       ).mapInArrow(count, "doc_id bigint, fp bigint")


def embedding(fp: Column) -> Column:
    """The 32 bit counts of a fingerprint's segments, two bits each, in one number."""
    low, high = fp.bitwiseAND(_LOW), F.shiftrightunsigned(fp, 1).bitwiseAND(_LOW)
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two embedded points: a count differs by one if the lower bits differ, by two if only the upper do."""
    differ = a.bitwiseXOR(b)
    low = differ.bitwiseAND(_LOW)
    high = F.shiftrightunsigned(differ, 1).bitwiseAND(_LOW)
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def links(points: DataFrame, cell_points: int = CELL_POINTS) -> DataFrame:
    """(u, v) over distinct fingerprints `fp`, connecting all those within two bits.

    Pairs of sparse cells are all links there are; those of crowded cells
    connect the same fingerprints by fewer pairs, all within two bits.
    """
    grids = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("point").bitwiseAND(_signed(m)).alias("cell"))
                      for i, m in enumerate(_GRIDS)])
    cells = points.select("fp", embedding(F.col("fp")).alias("point")).select(
        "fp", "point", F.explode(grids).alias("c")).select("c.grid", "c.cell", "fp", "point")
    counts = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(cells.join(counts, ["grid", "cell"]), "cells")

    sparse = shared.where(F.col("n") <= cell_points)
    left = sparse.select("grid", "cell", F.col("fp").alias("u"), F.col("point").alias("p"))
    right = sparse.select("grid", "cell", F.col("fp").alias("v"), F.col("point").alias("q"))
    pairs = left.join(right, ["grid", "cell"]).where(
        (F.col("u") < F.col("v")) & (manhattan(F.col("p"), F.col("q")) <= RADIUS)
        & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)).select("u", "v")

    crowded = shared.where(F.col("n") > cell_points).select("fp").distinct()
    flips = F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64)])
    near = crowded.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("near"))
    least = near.groupBy("near").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = near.join(least, "near").where("fp != v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    `component_id` is the smallest id reachable over links of two bits or fewer.
    Documents move as (id, fingerprint) rows only.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    labels = components(links(points.select("fp")))
    named = points.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "label").select("fp", "component_id"), "fp")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
