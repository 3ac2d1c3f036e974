"""Whitening of embeddings by a bit-sliced scatter.

Components become whole numbers, z = floor(scale * c). Every different vector of
them counts once for the fit. Of a chunk of vectors each dimension is shifted to
begin at 0 and cut into bit planes, packed across the rows into 64-bit words; the
sum of the products of two dimensions is then the sum, over pairs of their planes,
of the popcount of the planes' AND, weighted by both bits. These sums are exact
whatever the shift, add up over chunks, tasks and shards as decimals, and give the
covariance over n vectors as (n * sum(zi * zj) - sum(zi) * sum(zj)) / n^2, divided
only at the end. A number added to all components changes none of the results.
The eigenvectors are found once per length, in a task, from the d^2 sums.

Nulls and odd rows: a null vector, or one with a null or non-finite component,
takes no part; a null id is kept; rows that repeat each get a row. Vectors are
fitted with those of equal length only. A component beyond 2^45 / scale is held
there. A component whose variance is 0 to double precision has a null `whitened`;
so have all if there is one vector only, and their share is null. An empty vector
has no components. An empty table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.sources.workspace import written

CHUNK_ROWS = 1 << 12      # rows of a set of bit planes
BLOCK_ROWS = 1 << 9       # rows projected at once
BLOCK_NUMBERS = 1 << 18   # fewer rows where vectors are long
LARGEST = 1 << 45
SINGULAR = 1e-11          # share of the largest variance below which a variance is rounding

_EXACT = pa.decimal128(38, 0)
MODEL = ("length int, n bigint, sums array<decimal(38,0)>, axes binary, scales array<double>, "
         "explained array<double>")
#: What `whiten` returns.
WHITE = ("vec_id bigint, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, "
         "identity_error double")


def _fit_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, z) of the rows that take part."""
    def whole(c: Column) -> Column:
        most = F.lit(float(LARGEST))
        return F.floor(F.least(F.greatest(c * F.lit(float(scale)), -most), most))

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("c")).where(
        F.col("c").isNotNull() & F.forall("c", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).select("vec_id", F.transform("c", whole).alias("z"))


def _matrices(b: pa.RecordBatch, column: str = "z") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    lists = b[column]
    at = lists.offsets.to_numpy()
    lengths, numbers = np.diff(at), lists.values.to_numpy()
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, numbers[at[rows][:, None] + np.arange(d)]


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of whole numbers from 0 on, packed across rows: words, and the dimension and bit of each.

    Planes without a bit are left out; they are in the order of their dimensions.
    """
    m, d = y.shape
    padded = np.zeros((-(-m // 64) * 64, d), np.int64)
    padded[:m] = y
    words, dims, bits = [], [], []
    for bit in range(int(y.max(initial=0)).bit_length()):
        packed = np.packbits(((padded >> bit) & 1).astype(np.uint8), axis=0)
        packed = np.ascontiguousarray(packed.T).view(np.uint64)
        some = np.flatnonzero(packed.any(axis=1))
        words.append(packed[some])
        dims.append(some)
        bits.append(np.full(len(some), bit))
    if not words:
        return np.zeros((0, len(padded) // 64), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    dims, bits = np.concatenate(dims), np.concatenate(bits)
    order = np.lexsort((bits, dims))
    return np.concatenate(words)[order], dims[order], bits[order]


def scatter(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each column of whole numbers and of the products of each two (upper half), as exact integers."""
    m, d = z.shape
    low = z.min(axis=0) if m else np.zeros(d, np.int64)
    words, dims, bits = planes(z - low)
    wide = 2 * int(bits.max(initial=0)) + m.bit_length() + 2 > 62  # products beyond a long
    cross = np.zeros((d, d), object if wide else np.int64)
    sums = np.zeros(d, object)
    for r in range(len(dims)):
        counts = np.bitwise_count(words[r] & words[r:]).sum(axis=1, dtype=np.int64)
        sums[dims[r]] += int(counts[0]) << int(bits[r])
        counts[1:] *= 1 + (dims[r + 1:] == dims[r])  # two planes of one dimension meet twice
        weight = bits[r:] + bits[r]
        weighted = counts.astype(object) * np.array([1 << int(w) for w in weight], object) if wide \
            else counts << weight
        np.add.at(cross[dims[r]], dims[r:], weighted)
    cross, low = cross.astype(object), low.astype(object)
    cross = cross + low[:, None] * sums[None, :] + sums[:, None] * low[None, :] + m * low[:, None] * low[None, :]
    return sums + m * low, cross


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, i, j, v) of all vectors of a task: numbers of rows at (-1, -1), sums at (-1, j), products."""
    held: dict[int, list] = {}
    totals: dict[int, list] = {}

    def add(d: int) -> None:
        z = np.concatenate(held.pop(d))
        for first in range(0, len(z), CHUNK_ROWS):
            part = z[first:first + CHUNK_ROWS]
            found = totals.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
            sums, cross = scatter(part)
            found[0], found[1], found[2] = found[0] + len(part), found[1] + sums, found[2] + cross

    for b in batches:
        for _, z in _matrices(b):
            d = z.shape[1]
            held.setdefault(d, []).append(z)
            if sum(map(len, held[d])) >= CHUNK_ROWS:
                add(d)
    for d in list(held):
        add(d)
    for d, (n, sums, cross) in totals.items():
        i, j = np.triu_indices(d)
        values = [n, *sums, *cross[i, j]]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(values), d, np.int32)),
            pa.array(np.concatenate((np.full(1 + d, -1), i)).astype(np.int32)),
            pa.array(np.concatenate(([-1], np.arange(d), j)).astype(np.int32)),
            pa.array([Decimal(int(v)) for v in values], _EXACT)], names=["length", "i", "j", "v"])


def fit(n: int, sums: np.ndarray, cross: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes (one per column), their variances and shares, from exact sums; the first `most` by variance."""
    d = len(sums)
    if not d:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0)
    centred = n * cross - sums[:, None] * sums[None, :]
    values, axes = np.linalg.eigh((centred / (n * n)).astype(np.float64), UPLO="U")
    trace = int(np.trace(centred)) / (n * n)
    values, axes = values[::-1][:most].copy(), axes[:, ::-1][:, :most]
    values[values <= SINGULAR * values[0]] = 0
    return axes, values, values / trace if trace > 0 else np.full(len(values), np.nan)


def _models(sums: DataFrame, most: int) -> DataFrame:
    def solve(t: pa.Table) -> pa.Table:
        d = t["length"][0].as_py()
        i, j = t["i"].to_numpy(), t["j"].to_numpy()
        v = np.array([int(x) for x in t["v"].to_pylist()], object)
        n = int(v[(i < 0) & (j < 0)][0])
        linear, cross = np.zeros(d, object), np.zeros((d, d), object)
        one = (i < 0) & (j >= 0)
        linear[j[one]] = v[one]
        cross[i[i >= 0], j[i >= 0]] = v[i >= 0]
        axes, values, share = fit(n, linear, cross, most)
        return pa.table({
            "length": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()),
            "sums": pa.array([[Decimal(int(x)) for x in linear]], pa.list_(_EXACT)),
            "axes": pa.array([np.ascontiguousarray(axes).tobytes()], pa.binary()),
            "scales": pa.array([np.sqrt(values).tolist()], pa.list_(pa.float64())),
            "explained": pa.array([[None if np.isnan(x) else x for x in share.tolist()]], pa.list_(pa.float64()))})

    return sums.groupBy("length").applyInArrow(solve, MODEL)


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows in blocks of one length each, so that a model goes with a block, not with a row."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, z in _matrices(b):
                step = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, z.shape[1])))
                for first in range(0, len(at), step):
                    part = at[first:first + step]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([z.shape[1]], pa.int32()),
                        pa.array([b["vec_id"].take(pa.array(part)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([z[first:first + step].ravel()], pa.list_(pa.int64()))],
                        names=["length", "ids", "numbers"])

    return rows.mapInArrow(block, "length int, ids array<bigint>, numbers array<bigint>")


def _whitened(b: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the block in row r: n * z - sums, exact, and the projections; and which of them have a variance."""
    d, n = b["length"][r].as_py(), b["n"][r].as_py()
    sums = np.array([int(x) for x in b["sums"][r].as_py()], object)
    rows = len(b["ids"][r])
    z = b["numbers"][r].values.to_numpy().reshape(rows, d)
    most = n * int(np.abs(z).max(initial=0)) + max((abs(int(s)) for s in sums), default=0)
    off = n * z - sums.astype(np.int64) if most < 2**62 else n * z.astype(object) - sums
    scales = np.array(b["scales"][r].as_py())
    axes = np.frombuffer(b["axes"][r].as_py(), np.float64).reshape(d, -1) if d else np.zeros((0, 0))
    white = (off / n).astype(np.float64) @ axes / np.where(scales > 0, scales, 1)
    return off, white, scales > 0


def _deviations(off: np.ndarray) -> list[Decimal]:
    """Sums of squares of each row, exact; beyond 38 digits held there."""
    most = int(np.abs(off).max(initial=0))
    if off.dtype == np.int64 and most * most * max(1, off.shape[1]) < 2**63:
        return [Decimal(v) for v in (off * off).sum(axis=1).tolist()]
    return [Decimal(min(sum(int(x) ** 2 for x in row), 10**38 - 1)) for row in off]


def _project(joined: DataFrame) -> DataFrame:
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                off, white, real = _whitened(b, r)
                m, k = white.shape
                values = pa.array(white.ravel(), mask=np.broadcast_to(~real, white.shape).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * k), values)
                same = {c: b[c].take(pa.array(np.full(m, r))) for c in ("n", "explained", "identity_error")}
                yield pa.RecordBatch.from_arrays(
                    [b["ids"][r].values, same["n"], pa.array(_deviations(off), _EXACT), lists, same["explained"],
                     same["identity_error"]],
                    names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return joined.mapInArrow(project, WHITE)


def _identity_errors(joined: DataFrame) -> DataFrame:
    """(length, identity_error): how far the covariance of the whitened fit list is from the identity, at most."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                _, white, real = _whitened(b, r)
                white = white[:, real]
                k = white.shape[1]
                i, j = np.triu_indices(k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(i), b["length"][r].as_py(), np.int32)),
                    pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                    pa.array(np.full(len(i), len(white), np.int64)), pa.array((white.T @ white)[i, j]),
                    pa.array(white.sum(axis=0)[i]), pa.array(white.sum(axis=0)[j])],
                    names=["length", "i", "j", "m", "ij", "si", "sj"])

    found = joined.mapInArrow(
        moments, "length int, i int, j int, m bigint, ij double, si double, sj double").groupBy("length", "i", "j").agg(
        *[F.sum(c).alias(c) for c in ("m", "ij", "si", "sj")])
    covariance = F.col("ij") / F.col("m") - F.col("si") / F.col("m") * (F.col("sj") / F.col("m"))
    return found.groupBy("length").agg(
        F.max(F.abs(covariance - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of every row that takes part.

    `deviation` is the sum of (n * z - sums)^2 over dimensions, exact; `whitened` and
    `explained` are arrays of the first components, largest variance first.
    """
    rows = _fit_rows(vectors, scale)
    # equal vectors are joined before they are shuffled, so many copies of one are no load
    different = written(rows.select("z").distinct().withColumn("vec_id", F.lit(None).cast("bigint")), "fit-list")
    sums = different.select("z").mapInArrow(_partials, "length int, i int, j int, v decimal(38,0)").groupBy(
        "length", "i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    axes = written(_models(sums, components), "axes")
    errors = _identity_errors(_blocks(different).join(axes, "length"))
    models = written(axes.join(errors, "length", "left"), "models")
    # adaptive execution splits a frequent length where models are too large to be sent to every task
    return _project(_blocks(rows).join(models, "length"))
