"""Mixing documents to target weights of domains that they belong to softly.

A classifier learned from a labelled table gives each document a posterior over
the domains. A document's rate is the number of times it is to be used; the
expected tokens of a domain are the sum of rate * tokens * posterior. Projected
gradient steps fit nonnegative rates whose totals match the targets in the least
squares sense, from equal rates on:

    rate <- max(0, rate - posterior . g),   g = A^-1 (totals - targets),

where A is the sum of tokens * posterior posterior' over the documents in use, those
of a rate above zero (over all documents where that step would not come closer).
One step matches any targets that need no rate below zero, and more steps settle
the rest. One step costs one pass over
(tokens, posterior) rows, which are written once, and moves as many numbers as
there are domains; rates follow from the steps so far, so nothing is kept between
passes that a lost executor could take away.

Tokens are words between ASCII white space. Nulls and odd rows: a null text has
no tokens and, like an empty one, the posterior of a text without features; null
ids and repeated rows each get a row; labels that are null teach nothing. With no
labelled row the posterior is uniform. A domain without any mass can't be
matched; the others are. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwright.llm.features import (
    DIMENSIONS, frequencies, in_slices, joined_sample, softmax, softmax_regression, with_bias)
from stepwright.sources.workspace import written

SAMPLE_ROWS = 2000
STEPS = 40
TOLERANCE = 1e-9

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words between ASCII white space, per text."""
    if not len(data):
        return np.zeros(len(at) - 1, np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(data)]
    begins[first] = inside[first]
    total = np.concatenate(([0], np.cumsum(begins)))
    return total[at[1:]] - total[at[:-1]]


def classifier(docs: DataFrame, labels: DataFrame, label: Column, domains: list[str],
               sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights (features and a bias, by domain) of a multinomial logistic model over hashed grams.

    Learned on the driver from at most 2 * sample_rows texts that `labels` (doc_id
    and what `label` needs) knows. Domains are about equally frequent in that
    sample; their shares of the whole labelled table turn answers into posteriors.
    """
    known = labels.where(label.isin(domains))
    found, x = joined_sample(docs, known, label, sample_rows)
    weights = np.zeros((DIMENSIONS + 1, len(domains)))
    if found:
        place = {d: i for i, d in enumerate(domains)}
        y = np.array([place[d] for d in found])
        weights = softmax_regression(x, y, len(domains))
        share = {r[0]: r[1] for r in known.groupBy(label.alias("label")).count().collect()}
        prior = np.array([share.get(d, 0) for d in domains], float) / max(1, sum(share.values()))
        sampled = np.bincount(y, minlength=len(domains)) / len(y)
        weights[-1] += np.where(sampled > 0, np.log(np.maximum(prior, 1e-12) / np.maximum(sampled, 1e-12)), -30.0)
    return weights


def posteriors(docs: DataFrame, weights: np.ndarray, keep: Column | None = None,
               steps: list[np.ndarray] | None = None, start: float = 1.0) -> DataFrame:
    """(row, n_tokens, p) of every row: `keep`, by default the id; words; and posteriors by domain.

    With gradient steps also `rate`, as `with_rates` would add it.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, data, at in in_slices(b):
                p = softmax(with_bias(frequencies(data, at)) @ weights)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                columns = [b["row"].slice(low, high - low), pa.array(word_counts(data, at)), flat]
                if steps is not None:
                    columns.append(pa.array(rates_after(p, steps, start)))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n_tokens", "p", "rate"][:len(columns)])

    chosen = docs.select((F.col("doc_id") if keep is None else keep).alias("row"),
                         F.col("text").cast("binary").alias("raw"))
    return chosen.mapInArrow(predict, T.StructType(
        [chosen.schema["row"], T.StructField("n_tokens", T.LongType()),
         T.StructField("p", T.ArrayType(T.DoubleType()))]
        + ([] if steps is None else [T.StructField("rate", T.DoubleType())])))


def _matrix(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (b["n_tokens"].to_numpy().astype(float),
            b["p"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width))


def rates_after(p: np.ndarray, steps: list[np.ndarray], start: float) -> np.ndarray:
    """Rates of documents with posteriors `p` after these gradient steps."""
    rate = np.full(len(p), start)
    for g in steps:
        rate = np.maximum(0.0, rate - p @ g)
    return rate


def _sums(table: DataFrame, width: int, value) -> np.ndarray:
    """Sum over all rows of the vectors that `value` makes of a batch's tokens and posteriors."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            found = value(*_matrix(b, width))
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    found = table.select("n_tokens", "p").mapInArrow(partial, "i bigint, x double").groupBy("i").agg(
        F.sum("x").alias("x")).collect()
    return np.array([x for _, x in sorted((r[0], r[1]) for r in found)])


def fit_rates(table: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[list[np.ndarray], float, np.ndarray]:
    """Gradient steps, starting rate, and the totals reached, for rows (n_tokens, p) that are read many times.

    `targets` are the domains' weights; totals aim at these shares of all tokens.
    """
    d = len(targets)
    gram = _sums(table, d, lambda n, p: (p.T @ (n[:, None] * p)).ravel())
    if not len(gram):
        return [], 1.0, np.zeros(d)
    gram = gram.reshape(d, d)
    everything = gram.sum()  # posteriors sum to one, so this is the number of tokens
    goal = everything * np.array(targets) / sum(targets)
    inverse = np.linalg.pinv(gram, rcond=1e-10, hermitian=True)
    done: list[np.ndarray] = []
    totals, active = gram.sum(axis=1), gram

    def distance(reached: np.ndarray) -> float:
        return float((reached - goal) @ inverse @ (reached - goal))

    for _ in range(steps):
        residual = totals - goal
        if np.abs(residual).max(initial=0.0) <= TOLERANCE * max(everything, 1.0):
            break
        better = False
        # the metric of the documents still in use goes further; that of all documents never goes astray
        for metric in (active, gram):
            step = np.linalg.pinv(metric, rcond=1e-10, hermitian=True) @ residual
            found = _sums(table, d, lambda n, p, to=(*done, step): _state(rates_after(p, list(to), 1.0), n, p))
            now = found[:d]
            if distance(now) < distance(totals) * (1 - 1e-9):
                better = distance(now) < distance(totals) * (1 - 1e-6)
                done.append(step)
                totals, active = now, found[d:].reshape(d, d)
                break
        if not better:  # what is left can't be matched
            break
    return done, 1.0, totals


def _state(rate: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected tokens by domain at these rates, and the matrix A of the documents in use."""
    used = p * (n * (rate > 0))[:, None]
    return np.concatenate(((rate * n) @ p, (used.T @ p).ravel()))


def with_rates(table: DataFrame, steps: list[np.ndarray], start: float) -> DataFrame:
    """`table` with the column `rate`."""
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b["p"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield b.append_column("rate", pa.array(rates_after(p, steps, start)))

    return table.mapInArrow(rate, T.StructType([*table.schema.fields, T.StructField("rate", T.DoubleType())]))


def mix(docs: DataFrame, labels: DataFrame, label: Column, targets: dict[str, float]) -> DataFrame:
    """(doc_id, n_tokens, p, rate) of every row."""
    table = written(posteriors(docs, classifier(docs, labels, label, list(targets))), "posteriors")
    steps, start, _ = fit_rates(table, list(targets.values()))
    return with_rates(table, steps, start).withColumnRenamed("row", "doc_id")


def mix_rows(docs: DataFrame, labels: DataFrame, label: Column, targets: dict[str, float]) -> DataFrame:
    """(row, n_tokens, p, rate, doc_id, text): `row` holds all columns of `docs`.

    Rates are fitted on rows without texts; a second scan gives every document its
    own, so that texts are neither written nor shuffled.
    """
    weights = classifier(docs, labels, label, list(targets))
    steps, start, _ = fit_rates(written(posteriors(docs, weights), "posteriors"), list(targets.values()))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return posteriors(docs, weights, whole, steps, start).withColumns(
        {"doc_id": F.col("row.doc_id"), "text": F.col("row.text")})


def copies(rate: Column, *seed: Column) -> Column:
    """A whole number of copies whose mean over documents is the rate; the same at every run."""
    share = F.pmod(F.xxhash64(*seed), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + share).cast("int")
