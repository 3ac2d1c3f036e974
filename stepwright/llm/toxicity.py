"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, takes compatibility forms (wide, mathematical, ligatures) for
the letters they stand for, drops accents and invisible format characters, maps
letters of other scripts that look like Latin ones to these, and digits and signs
that stand for letters wherever a run of them touches a letter and no other digit;
what is no letter or digit separates words. Lexicon entries are whole words (" idiot ") or
beginnings of words (" idio"), exceptions are words or phrases in which an entry
doesn't count. One automaton finds both in one pass over the text.

The sum of the weights found, per word of the text, goes through a logistic
curve: score = 1 / (1 + exp(-(intercept + slope * log(1 + 1000 * sum / words)))).

`learn` takes entries, weights, exceptions and curve from a bounded sample of
labelled texts: at most SAMPLE_ROWS of either label, one of equal texts. Entries
are word beginnings of four to six letters, or whole words, that at least
LEAST_SHARE of the toxic texts hold and hardly any other; their weight is the
logarithm of how much likelier a toxic text is to hold them. Exceptions are words
and pairs of words around an entry that only harmless texts hold.

Nulls and odd rows: a null text is scored like an empty one; null ids and
repeated rows each get a row; null labels teach nothing, and with no toxic label
every score is 0. An empty table gives no rows. Columns other than those named
are passed through or not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 10_000
LEAST_SHARE = 0.02
LEAST_TEXTS = 5
LEAST_WEIGHT = 4.0
PREFIXES = (4, 5, 6)
HELD_MARKS = 100_000   # that a task counts before it passes them on

#: Letters of other scripts by the Latin letter they look like.
LOOKALIKES = {
    "a": "аαａ", "b": "Ьｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ", "f": "ｆ", "g": "ɡｇ", "h": "һｈ", "i": "іιıｉ",
    "j": "јｊ", "k": "кκｋ", "l": "ӏⅼｌ", "m": "мｍ", "n": "пηｎ", "o": "оοｏ", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ",
    "s": "ѕｓ", "t": "тτｔ", "u": "υцｕ", "v": "ѵνｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ",
}
#: Digits and signs that stand for a letter next to another letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_LETTERS = {ord(c): latin for latin, others in LOOKALIKES.items() for c in others}


class _Folded(dict):
    """Code point to its folded text, worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(code)).lower()
        self[code] = "".join(c for c in parts if unicodedata.category(c) not in ("Mn", "Cf")).translate(_LETTERS)
        return self[code]


_FOLDED = _Folded()
_STANDING_IN = re.compile(
    r"(?<=[^\W\d_])[0134578@$]+(?=[^\W\d_]|(?![^\W_]))|(?<![^\W_])[0134578@$]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    text = text.lower() if text.isascii() else text.translate(_FOLDED)
    text = _STANDING_IN.sub(lambda m: "".join(SUBSTITUTES[c] for c in m.group()), text)
    return _WORD.findall(text)


@dataclass
class Lexicon:
    entries: dict[str, float] = field(default_factory=dict)   # " word " or " beginning"
    exceptions: list[str] = field(default_factory=list)       # words or phrases, folded
    intercept: float = -math.inf
    slope: float = 0.0

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        for entry, weight in lexicon.entries.items():
            self.automaton.add_word(entry, (len(entry), weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Place in " " + words + " " and weight of every entry found outside exceptions; the longest at a place."""
        if not len(self.automaton):
            return []
        line = f" {' '.join(words)} "
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(line):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif start not in found or found[start][0] < length:
                found[start] = (length, weight)
        if not spared:
            return [(start, weight) for start, (_, weight) in found.items()]
        spared.sort()
        begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))

        def covered(start: int) -> bool:
            before = bisect_right(begins, start)
            return before > 0 and start < reach[before - 1]

        return [(start, weight) for start, (_, weight) in found.items() if not covered(start)]

    def density(self, words: list[str]) -> tuple[float, int]:
        """log(1 + 1000 * weights / words), and the number of hits."""
        hits = self.hits(words)
        return math.log1p(1000 * sum(w for _, w in hits) / max(1, len(words))), len(hits)

    def score(self, density: float) -> float:
        if self.lexicon.intercept == -math.inf:
            return 0.0
        z = self.lexicon.intercept + self.lexicon.slope * density
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _marks(words: list[str]) -> set[str]:
    """Entries that a text could teach."""
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if len(w) > k)
    return {m for m in out if len(m) > 4}


def _counts(sample: DataFrame, marks) -> DataFrame:
    """(mark, toxic, harmless): sampled texts with each mark; counted in each task, then shuffled."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            names = list(seen[0] | seen[1])
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[1][m] for m in names], pa.int64()),
                 pa.array([seen[0][m] for m in names], pa.int64())], names=["mark", "toxic", "harmless"])
            seen[0].clear()
            seen[1].clear()
            return out

        for b in batches:
            for text, label in zip(b["text"], b["toxic"].to_pylist()):
                seen[label].update(marks(fold(text.as_py())))
                if len(seen[0]) + len(seen[1]) > HELD_MARKS:
                    yield counted()
        yield counted()

    return sample.mapInArrow(count, "mark string, toxic bigint, harmless bigint").groupBy("mark").agg(
        F.sum("toxic").alias("toxic"), F.sum("harmless").alias("harmless"))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of labelled texts, and how many labels each sampled one stands for."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, most / max(1, counts.get(1, 0)))).otherwise(
        min(1.0, most / max(1, counts.get(0, 0))))
    # the bound of what is broadcast: ids and labels
    picked = known.where(place < share).limit(4 * most)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").select(
        "text", "toxic").dropDuplicates(["text", "toxic"])
    return texts, {k: max(1.0, counts.get(k, 0) / most) for k in (0, 1)}


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic regression with a slight penalty, by Newton steps."""
    a = np.stack([np.ones(len(x)), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + 1e-2 * w
        step = np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(2), gradient)
        w -= step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """A lexicon from `docs` (doc_id, text) and `labels` (doc_id, toxic 0 or 1), by a bounded sample."""
    sample, stands_for = _sample(docs, labels, sample_rows)
    sample = sample.persist()
    try:
        n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
        if not n.get(1):
            return Lexicon()
        least = max(LEAST_TEXTS if n[1] >= 20 else 1, LEAST_SHARE * n[1])
        # a text holds so many marks, so few of them can reach this share of the toxic ones
        found = _counts(sample, _marks).where(
            (F.col("toxic") >= least) & (F.col("harmless") * 20 * n[1] <= F.col("toxic") * max(1, n.get(0, 0)))).collect()
        weighed = []
        for mark, toxic, harmless in found:
            weight = math.log((toxic + 0.5) / (n[1] + 1)) - math.log((harmless + 0.5) / (n.get(0, 0) + 1))
            if weight >= LEAST_WEIGHT or (n[1] < 200 and weight > 0 and harmless == 0):
                weighed.append((len(mark), -weight, mark))
        entries: dict[str, float] = {}
        for _, weight, mark in sorted(weighed):  # a beginning stands for what begins with it
            if not any(mark.startswith(e) for e in entries):
                entries[mark] = -weight
        lexicon = Lexicon(entries)

        def around(words: list[str], matcher: Matcher = lexicon.matcher()) -> set[str]:
            line, out, i, last = f" {' '.join(words)} ", set(), 0, 0
            for start in sorted(start for start, _ in matcher.hits(words)):
                i, last = i + line.count(" ", last, start), start
                out.add(words[i])
                out.update(" ".join(p) for p in (words[i - 1:i + 1], words[i:i + 2]) if len(p) == 2)
            return out

        if n.get(0):
            spared = _counts(sample, around).where("toxic = 0 and harmless > 1").select("mark").collect()
            lexicon.exceptions = sorted(r[0] for r in spared)
        matcher = lexicon.matcher()

        def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = [matcher.density(fold(t))[0] for t in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b["toxic"]], names=["x", "toxic"])

        points = sorted(tuple(r) for r in sample.mapInArrow(densities, "x double, toxic int").collect())
        x, y = (np.array(c, float) for c in zip(*points))
        lexicon.intercept, lexicon.slope = _curve(x, y, np.where(y == 1, stands_for[1], stands_for[0]))
        return lexicon
    finally:
        sample.unpersist()


def score(docs: DataFrame, lexicon: Lexicon, names: tuple[str, str] = ("score", "n_hits")) -> DataFrame:
    """`docs` with a score (0 to 1) and its number of hits, as columns `names`, which `docs` must not have.

    All other columns pass through, in the scan's tasks.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for b in batches:
            found = [matcher.density(fold(t.as_py() or "")) for t in b["text"]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([matcher.score(x) for x, _ in found], pa.float64()),
                 pa.array([n for _, n in found], pa.int64())], names=[*b.schema.names, *names])

    return docs.mapInArrow(find, T.StructType(
        [*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.LongType())]))
