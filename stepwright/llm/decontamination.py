"""Benchmark decontamination by winnowing.

Texts are words after ASCII lower-casing. Of every run of SPAN words each text
keeps the least hash of its K-word grams (the first, of equal ones), so two
texts that share a run of SPAN words keep a common fingerprint inside it:
Spark joins document and benchmark fingerprints, and each hit is extended word by
word to both sides, as far as a shared run of SPAN words around it can reach.
A run counts if it is SPAN words long. An item of fewer words counts as a whole:
it is one gram of all its words, and documents keep all grams of that length.

What extends a hit travels with its fingerprint: the words around it, at most
SPAN - 1 on either side of its first word. Fingerprints of documents are first
looked up in a bit map of the benchmark's, of FILTER_BITS bits whatever its
size, so that few of them are joined; a hit that the map lets through by chance
ends in the join. Texts are read once and never shuffled.

Nulls and odd rows: null texts have no words; items without words are ignored,
and so is the id of an item that has none (its words still count). Equal items
of different ids each count. Rows with equal or null ids each get a row. Empty
tables give no rows, or no hits. Only doc_id and text, or item_id and text, are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import LOWER, SpanHash, mix64, slices, text_of
from stepwright.sources.workspace import written

SPAN = 13
K = 5
FILTER_BITS = 22

# The bytes that words are made of, after lower-casing.
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[48:58] = _WORD_BYTES[97:123] = _WORD_BYTES[128:] = True

MARK = "struct<family:int,hash:bigint,place:bigint,first:bigint,words:string>"


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of lower-cased texts, and the text it is in."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD_BYTES[data]
    here = inside[1:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True  # a word ends with its text
    begin = np.flatnonzero(here & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(here & (~inside[2:] | cut[1:])) + 1
    return begin, end, np.searchsorted(at, begin, "right") - 1


def _grams(hashes: np.ndarray, k: int, family: int) -> np.ndarray:
    """Hashes of all runs of k words; grams of different families never meet."""
    n = max(len(hashes) - k + 1, 0)
    out = np.full(n, family, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n])
    return out


def _kept(grams: np.ndarray, owner: np.ndarray, span: int, k: int) -> np.ndarray:
    """Places of the grams that are the least of a run of `span` words within one text."""
    width, n = span - k + 1, len(owner) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = np.flatnonzero(owner[:n] == owner[span - 1:])
    runs = np.lib.stride_tricks.sliding_window_view(grams, width)[:n]
    kept = np.zeros(len(grams), bool)
    for first in range(0, len(whole), 1 << 18):
        part = whole[first:first + (1 << 18)]
        kept[part + runs[part].argmin(axis=1)] = True
    return np.flatnonzero(kept)


def _marks(data: np.ndarray, at: np.ndarray, lengths: list[int], is_item: bool, passes) -> tuple:
    """Number of words per text; and per text its fingerprints with the words around them."""
    data = LOWER[data]
    begin, end, owner = _words(data, at)
    counts = np.bincount(owner, minlength=len(at) - 1)
    first_word = np.concatenate(([0], np.cumsum(counts)))
    hashes = SpanHash(data).of(begin, end)
    raw = data.tobytes()
    found: list[list] = [[] for _ in range(len(at) - 1)]
    for family in lengths:
        k = K if family == SPAN else family
        if len(begin) < k:
            continue
        grams = _grams(hashes, k, family)
        if family == SPAN:
            places = _kept(grams, owner, SPAN, K)
        else:
            places = np.flatnonzero(owner[:len(grams)] == owner[k - 1:])
        if is_item:  # an item is in one family only
            places = places[np.minimum(counts[owner[places]], SPAN) == family]
        places = places[passes(grams[places])]
        for p, gram in zip(places.tolist(), grams[places].view(np.int64).tolist()):
            text = owner[p]
            low, high = max(p - (SPAN - k), first_word[text]), min(p + SPAN, first_word[text + 1])
            if family != SPAN:
                low, high = p, p + k
            words = b" ".join([raw[s:e] for s, e in zip(begin[low:high].tolist(), end[low:high].tolist())])
            found[text].append({"family": family, "hash": gram, "place": int(p - first_word[text]),
                                "first": int(low - first_word[text]), "words": words.decode("utf-8", "replace")})
    return counts, found


def _marked(table: DataFrame, id_column: str, kind: str, lengths: list[int], is_item: bool,
            allowed: bytes | None) -> DataFrame:
    """(id, n_words, marks) of every row."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if allowed is None else np.unpackbits(np.frombuffer(allowed, np.uint8)).view(bool)

        def passes(grams: np.ndarray) -> np.ndarray:
            if bits is None:
                return np.ones(len(grams), bool)
            return bits[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]

        for b in batches:
            data, at = text_of(b["raw"])
            for low, high in slices(at):
                counts, found = _marks(data[at[low]:at[high]], at[low:high + 1] - at[low], lengths, is_item, passes)
                yield pa.RecordBatch.from_arrays(
                    [b["id"].slice(low, high - low), pa.array(counts.astype(np.int64)),
                     pa.array(found, pa.list_(pa.struct([
                         ("family", pa.int32()), ("hash", pa.int64()), ("place", pa.int64()), ("first", pa.int64()),
                         ("words", pa.string())])))],
                    names=["id", "n_words", "marks"])

    return table.select(F.col(id_column).cast(kind).alias("id"), F.col("text").cast("binary").alias("raw")).mapInArrow(
        mark, f"id {kind}, n_words bigint, marks array<{MARK}>")


def bit_map(marks: DataFrame) -> bytes:
    """Bits set at the upper FILTER_BITS of all hashes; at most 2^FILTER_BITS numbers reach the driver."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    slots = marks.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("slot")).distinct()
    # gathered as packed words of 32 slots: bounded by the map, not by the benchmark
    packed = slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
    for word, value in packed.collect():
        for i in range(32):
            if value >> i & 1:
                bits[word * 32 + i] = True
    return np.packbits(bits).tobytes()


def _extended(joined: DataFrame) -> DataFrame:
    """(row, item, low, high): the document words from `low` up to `high` that a hit covers."""
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, items, lows, highs = [], [], [], []
            for r in b.to_pylist():
                mine, theirs = r["words"].split(" "), r["item_words"].split(" ")
                i, j = r["place"] - r["first"], r["item_place"] - r["item_first"]
                left = right = 0
                while left < min(i, j) and mine[i - left - 1] == theirs[j - left - 1]:
                    left += 1
                while right < min(len(mine) - i, len(theirs) - j) and mine[i + right] == theirs[j + right]:
                    right += 1
                if left + right >= r["family"] and right:
                    rows.append(r["row"])
                    items.append(r["item_id"])
                    lows.append(r["place"] - left)
                    highs.append(r["place"] + right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(items, pa.string()), pa.array(lows, pa.int64()),
                 pa.array(highs, pa.int64())], names=["row", "item_id", "low", "high"])

    return joined.mapInArrow(extend, "row bigint, item_id string, low bigint, high bigint")


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of every document row.

    `spans` are the runs of words found (low, high), sorted, `items` the ids
    found as sorted strings; both are null where there are none.
    """
    items = written(_marked(benchmark, "item_id", "string", list(range(1, SPAN + 1)), True, None), "items")
    item_marks = items.select(F.col("id").alias("item_id"), F.explode("marks").alias("m")).select("item_id", "m.*")
    lengths = sorted(r[0] for r in item_marks.select("family").distinct().collect())  # 13 values at most
    marked = _marked(docs, "doc_id", "bigint", lengths, False, bit_map(item_marks))
    rows = written(marked.withColumn("row", F.monotonically_increasing_id()), "marked")

    doc_marks = rows.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    known = item_marks.select(
        "family", "hash", "item_id", F.col("place").alias("item_place"), F.col("first").alias("item_first"),
        F.col("words").alias("item_words"))
    # one row for each surrounding that an item has of a fingerprint, however often it repeats in the item
    known = known.withColumn("_at", F.col("item_place") - F.col("item_first")).dropDuplicates(
        ["family", "hash", "item_id", "_at", "item_words"]).drop("_at")
    spans = _extended(doc_marks.join(known, ["family", "hash"])).distinct()
    hits = spans.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"))
    # the length of the union of sorted spans
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["high"] - F.greatest(s["low"], a["end"]), F.lit(0))).alias("n"),
                              F.greatest(a["end"], s["high"]).alias("end")),
        lambda a: a["n"])
    return rows.select("row", F.col("id").alias("doc_id"), "n_words").join(
        hits.withColumn("n_hit", covered), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), "spans", "items")


def contaminated(n_hit, n_words):
    """The rule: a hit, and at least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def words_of(text: str) -> list[str]:
    """The words as a plain expression; for tests and for users who look into a hit."""
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
