"""Hashed character grams of whole texts, and bounded labelled samples of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import LOWER, slices, text_of

DIMENSIONS = 1 << 11
SLICE_ROWS = 512   # of a dense matrix
MOST_LABELS = 100  # that are learned where labels aren't given


def frequencies(data: np.ndarray, at: np.ndarray, grams: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """One row per text: square roots of its byte grams' shares, in DIMENSIONS hashed columns.

    Rows have length one whatever the length of the text; a text shorter than
    every gram is all zero.
    """
    data, n = LOWER[data].astype(np.uint32), len(at) - 1
    out = np.zeros((n, DIMENSIONS))
    owner = np.repeat(np.arange(n), np.diff(at))
    for g in grams:
        m = len(data) - g + 1
        if m <= 0:
            continue
        code = np.full(m, g, np.uint32)
        with np.errstate(over="ignore"):
            for i in range(g):
                code = (code ^ data[i:i + m]) * np.uint32(0x85EBCA6B)
            code ^= code >> np.uint32(15)
        inside = owner[:m] == owner[g - 1:]
        slot = owner[:m] * DIMENSIONS + (code * np.uint32(0xC2B2AE35) >> np.uint32(21)).astype(np.int64)
        out += np.bincount(slot[inside], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def in_slices(b: pa.RecordBatch, column: str = "raw") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row + 1, bytes and offsets of runs of rows small enough for dense matrices."""
    data, at = text_of(b[column])
    for low, high in slices(at):
        for first in range(low, high, SLICE_ROWS):
            last = min(first + SLICE_ROWS, high)
            yield first, last, data[at[first]:at[last]], at[first:last + 1] - at[first]


def _bounded(rows: DataFrame, bound: int, least: int, *seed: str,
             most_labels: int | None = None) -> tuple[DataFrame, int]:
    """Rows (label, ...) whose hash of `seed` is smallest, about equally many of each label; and their bound.

    With `most_labels` only that many are taken, the most frequent, equal counts by name.
    """
    counted = rows.groupBy("label").count()
    if most_labels is not None:
        counted = counted.orderBy(F.desc("count"), "label").limit(most_labels)
    counts = {r[0]: r[1] for r in counted.collect()}
    if not counts:
        return rows.limit(0), 0
    each = max(least, bound // len(counts))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    place = F.pmod(F.xxhash64(*seed), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(place < share[F.col("label")]), 2 * each * len(counts)


def _vectors(picked: DataFrame, most: int) -> tuple[list, np.ndarray]:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, data, at in in_slices(b):
                found = frequencies(data, at).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [b["label"].slice(low, high - low), pa.array([x.tobytes() for x in found], pa.binary())],
                    names=["label", "vector"])

    kind = dict(picked.dtypes)["label"]
    found = picked.select("label", "raw").mapInArrow(vectors, f"label {kind}, vector binary").limit(most).collect()
    if not found:
        return [], np.zeros((0, DIMENSIONS))
    found.sort(key=lambda r: (r[0], bytes(r[1])))  # whatever the order of the tasks
    return [r[0] for r in found], np.stack([np.frombuffer(r[1], np.float32) for r in found]).astype(np.float64)


def labelled_sample(rows: DataFrame, label: Column, bound: int, least: int = 50) -> tuple[list, np.ndarray]:
    """Labels and features of a bounded sample of whole texts; the same one at every run.

    Each label gets about bound / number of labels rows (at least `least`), those
    whose hash of id and text is smallest; no more than twice that reach the driver.
    Labels beyond the MOST_LABELS most frequent (a column of dirty values) are not learned.
    """
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("raw"), label.alias("label")).where(
        F.col("label").isNotNull() & F.col("raw").isNotNull())
    return _vectors(*_bounded(rows, bound, least, "doc_id", "raw", most_labels=MOST_LABELS))


def joined_sample(docs: DataFrame, labels: DataFrame, label: Column, bound: int,
                  least: int = 50) -> tuple[list, np.ndarray]:
    """The same where labels are a table of their own (doc_id and what `label` needs).

    The sample is drawn from the labels, so what is broadcast to find its texts is
    bounded, and texts are not shuffled.
    """
    known = labels.select("doc_id", label.alias("label")).where("label is not null")
    picked, most = _bounded(known, bound, least, "doc_id")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).where("raw is not null")
    return _vectors(texts.join(F.broadcast(picked.limit(most)), "doc_id"), most)


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def linear_svm(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 12) -> np.ndarray:
    """Weights (bias last) of an L2-regularised squared-hinge support vector machine, by Newton steps."""
    x, y = with_bias(x), np.where(positive, 1.0, -1.0)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        a = x[active]
        # (I / cost + A'A) w = A'y through the smaller of the two sides
        if len(a) < x.shape[1]:
            new = a.T @ np.linalg.solve(a @ a.T + np.eye(len(a)) / cost, y[active])
        else:
            new = np.linalg.solve(a.T @ a + np.eye(x.shape[1]) / cost, a.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def softmax_regression(x: np.ndarray, label: np.ndarray, classes: int, penalty: float = 1e-3,
                       rounds: int = 300) -> np.ndarray:
    """Weights (rows: features, bias last) of a multinomial logistic model, by accelerated gradient steps."""
    x = with_bias(x)
    w = np.zeros((x.shape[1], classes))
    seen, before = w, w
    step = 1.0 / (0.5 * float(np.mean((x * x).sum(axis=1))) + penalty)
    onehot = np.eye(classes)[label]
    for t in range(rounds):
        gradient = x.T @ (softmax(x @ seen) - onehot) / len(x) + penalty * seen
        w = seen - step * gradient
        seen = w + t / (t + 3) * (w - before)
        before = w
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
