"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte grams of the whole text. A linear support vector machine
per family tells it from all others; within a family, one machine per pair of its
languages lets the two compete, and the language that wins most pairs is it (the
sum of margins, then the name, settle ties). All machines are trained on the
driver, on a sample of at most 2 * SAMPLE_ROWS labelled texts, about equally many
per language. Of more than `features.MOST_LABELS` languages the most frequent are
learned; with over 40, each has 50 texts, twice that at most.

A text that is null or has no letter is `und` with score 0. With no labelled row
at all every text is `und`. Null labels aren't learned from; null ids and
repeated rows each get a row; an empty table gives no rows. Columns other than
id, text and the label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.llm.features import frequencies, in_slices, labelled_sample, linear_svm, with_bias

SAMPLE_ROWS = 2000

#: Families of languages by ISO 639-1 code; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "hr", "sr"],
}


@dataclass
class Model:
    families: list[str]
    members: list[list[str]]          # languages of each family
    family_weights: np.ndarray        # features x families
    pairs: list[tuple[int, int, int]]  # family, and the places of two of its languages
    pair_weights: np.ndarray          # features x pairs

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row of features."""
        x = with_bias(x)
        margins = x @ self.family_weights
        family = margins.argmax(axis=1)
        duels = x @ self.pair_weights
        sure = _probability(margins.max(axis=1) - _second(margins)) if len(self.families) > 1 else np.ones(len(x))
        language = np.empty(len(x), object)
        score = np.zeros(len(x))
        for f, names in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            wins, sums = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for p, (of, a, b) in enumerate(self.pairs):
                if of == f:
                    m = duels[rows, p]
                    wins[:, a] += m >= 0
                    wins[:, b] += m < 0
                    sums[:, a] += m
                    sums[:, b] -= m
            order = np.lexsort((np.broadcast_to(np.arange(len(names)), wins.shape), -sums, -wins), axis=1)[:, 0]
            language[rows] = [names[i] for i in order]
            own = sums[np.arange(len(rows)), order] / max(1, len(names) - 1)
            score[rows] = sure[rows] * (_probability(own) if len(names) > 1 else 1.0)
        return language, score


def _second(x: np.ndarray) -> np.ndarray:
    return np.partition(x, x.shape[1] - 2, axis=1)[:, -2]


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))


def train(labels: list[str], x: np.ndarray, families: dict[str, list[str]] = FAMILIES) -> Model | None:
    if not labels:
        return None
    family_of = {lang: name for name, langs in families.items() for lang in langs}
    label = np.array(labels, object)
    names = sorted(set(labels))
    of = {lang: family_of.get(lang, lang) for lang in names}
    kinds = sorted(set(of.values()))
    members = [[lang for lang in names if of[lang] == kind] for kind in kinds]
    mine = np.array([of[lang] for lang in labels], object)
    family_weights = np.stack([linear_svm(x, mine == kind) for kind in kinds], axis=1) if len(kinds) > 1 \
        else np.zeros((x.shape[1] + 1, 1))
    pairs, weights = [], [np.zeros((x.shape[1] + 1, 0))]
    for f, langs in enumerate(members):
        for a, b in combinations(range(len(langs)), 2):
            rows = (label == langs[a]) | (label == langs[b])
            pairs.append((f, a, b))
            weights.append(linear_svm(x[rows], label[rows] == langs[a])[:, None])
    return Model(kinds, members, family_weights, pairs, np.hstack(weights))


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def identify(docs: DataFrame, training: DataFrame, label: Column, keep: list[str] = (),
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) of every row of `docs`, learned from `training` (doc_id, text, label)."""
    model = train(*labelled_sample(training, label, sample_rows))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, data, at in in_slices(b):
                part = b.slice(low, high - low)
                lettered = np.array([_has_letter(data[s:e].tobytes()) for s, e in zip(at, at[1:])], bool)
                language, score = np.full(high - low, "und", object), np.zeros(high - low)
                if model is not None and lettered.any():
                    found, sure = model.predict(frequencies(data, at))
                    language, score = np.where(lettered, found, "und"), np.where(lettered, sure, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part[c] for c in ("doc_id", *keep)] + [pa.array(language, pa.string()), pa.array(score)],
                    names=["doc_id", *keep, "lang_pred", "score"])

    rows = docs.select("doc_id", *keep, F.col("text").cast("binary").alias("raw"))
    kinds = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep))
    return rows.mapInArrow(predict, f"{fields}, lang_pred string, score double")
