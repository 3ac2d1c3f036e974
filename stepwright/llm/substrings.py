"""Removal of repeated byte strings: suffix arrays over content-defined shards.

A byte goes if it is covered by a string of LENGTH bytes that also starts
earlier: in a document of smaller id, or further left in the same one.

Equal strings have to meet in one shard. The anchor of a string of LENGTH bytes is
the least hash among its grams of GRAM bytes, which equal strings have in common.
Neighbouring strings mostly share it: a region is a run of strings of one anchor,
RUN at most. Regions are dealt out by their anchor, and each shard finds its
repeats by a suffix array built with induced sorting and permuted common prefixes
(`suffixes`). Every string is in one region.

What reaches the shards is kept small. Anchors that occur once repeat nothing.
Of regions that are equal byte for byte (hashes of 64 bits each for anchor and
region) the earliest stands for all, and the others are repeated from end to end.
An anchor all of whose regions are equal is settled by that, unless it occurs twice
in the region, as in periodic text. The regions of an anchor form one group of a shard; an anchor with more than GROUP_REGIONS different
ones, as at the edge of a passage that a large part of the corpus shares, is
no single group: its strings are counted by their hashes instead, which combine
before they are shuffled, and compared with the earliest of their kind.

Documents are shuffled twice, to cut out regions and to remove bytes; else only
hashes and places are moved, and joins on keys that may be hot are plain shuffle
joins, which adaptive execution splits.

Nulls and odd rows: a null text is empty; a null id comes before all others.
Rows of one id are one document to the rule: equal starts in them don't remove
each other. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.llm.common import SpanHash, slices, sliding_min, small_batches, text_of
from stepwright.llm.suffixes import repeated_starts
from stepwright.sources.workspace import new_path

LENGTH = 100
GRAM = 16
RUN = 128   # strings of a region; only periodic text reaches it
GROUP_REGIONS = 4096   # so that a group has about 1 MB at most
CHUNK_BYTES = 1 << 18   # segments that one suffix array is built over, or one group if that has more
SLICE_BYTES = 1 << 18   # texts that one numpy pass works on: a pass holds some dozens of times that
NO_ID = -(1 << 63)

SPAN = "did bigint, start bigint, end bigint, hash bigint"


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("did"), "doc_id",
                       F.coalesce("text", F.lit("")).cast("binary").alias("raw"))


def regions_of(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor, first byte, end and text of every region, whether it may repeat itself; and hashes of spans."""
    spans = SpanHash(data)
    n, width = len(data) - GRAM + 1, length - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none, none.astype(bool), spans
    begin = np.arange(n)
    grams = spans.of(begin, begin + GRAM)
    least = sliding_min(grams, width)                                   # by first byte of each string
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = owner[:len(least)] == owner[length - 1:]                    # those within one text
    string = np.flatnonzero(whole)
    if not len(string):
        return none.astype(np.uint64), none, none, none, none.astype(bool), spans
    anchor, of, place = least[string], owner[string], np.arange(len(string))
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % RUN == 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(string)) - 1
    start, end = string[first], string[last] + length

    # a string that occurs twice in a region has its anchor there twice, with no other anchor between
    edge = np.zeros(width - 1, np.uint64)
    around = ~sliding_min(~np.concatenate((edge, np.where(whole, least, 0), edge)), width)
    anchors = np.flatnonzero(around == grams)
    twice = np.flatnonzero(grams[anchors[1:]] == grams[anchors[:-1]])
    low = np.searchsorted(end, anchors[twice + 1] + GRAM, "left")
    high = np.searchsorted(start, anchors[twice], "right")
    marks = np.zeros(len(start) + 1, np.int64)
    held = low < high
    np.add.at(marks, low[held], 1)
    np.add.at(marks, high[held], -1)
    return anchor[first], start, end, of[first], np.cumsum(marks[:-1]) > 0, spans


def _instances(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, region, did, place): place is the region's start, whether it may repeat itself, and its length."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["did"].to_numpy()
            data, at = text_of(b["raw"])
            for low, high in slices(at, SLICE_BYTES):
                part, cut = data[at[low]:at[high]], at[low:high + 1] - at[low]
                hashes, start, end, owner, twice, spans = regions_of(part, cut, length)
                place = (start - cut[owner]) << 11 | twice.astype(np.int64) << 10 | (end - start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(spans.of(start, end).view(np.int64)),
                     pa.array(ids[low + owner]), pa.array(place)], names=["anchor", "region", "did", "place"])

    return docs.select("did", "raw").mapInArrow(find, "anchor bigint, region bigint, did bigint, place bigint")


def _start(place) -> Column:
    return F.shiftright(place, 11)


def _size(place) -> Column:
    return F.col(place).bitwiseAND(1023)


def _twice(place) -> Column:
    return F.col(place).bitwiseAND(1024) != 0


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, did, start, bytes) for wanted (anchor, region, did, place)."""
    lists = wanted.groupBy("did").agg(F.collect_list(F.struct("anchor", "region", "place")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, (data, at), lists = b["did"].to_numpy(), text_of(b["raw"]), b["wanted"]
            first = lists.offsets.to_numpy()
            anchor, region, place = (lists.values.field(c).to_numpy() for c in ("anchor", "region", "place"))
            for low, high in slices(at, SLICE_BYTES):
                part, items = data[at[low]:at[high]], slice(first[low], first[high])
                owner = np.repeat(np.arange(low, high), np.diff(first[low:high + 1]))
                start, size = place[items] >> 11, place[items] & 1023
                begin, limit = at[owner] - at[low] + start, at[owner + 1] - at[low]
                # another text of the same id may not have the region
                keep = np.flatnonzero(begin + size <= limit)
                begin, end = begin[keep], (begin + size)[keep]
                same = SpanHash(part).of(begin, end).view(np.int64) == region[items][keep]
                keep, begin, end, raw = keep[same], begin[same], end[same], part.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[items][keep]), pa.array(ids[owner[keep]]), pa.array(start[keep]),
                     pa.array([raw[x:y] for x, y in zip(begin.tolist(), end.tolist())], pa.binary())],
                    names=["anchor", "did", "start", "bytes"])

    return docs.select("did", "raw").join(lists, "did").mapInArrow(
        cut, "anchor bigint, did bigint, start bigint, bytes binary")


def _merged(owner: np.ndarray, offset: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of the runs that strings of `length` at sorted places cover."""
    if not len(owner):
        return owner, offset, offset
    new = np.append(True, (owner[1:] != owner[:-1]) | (offset[1:] > offset[:-1] + length))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], offset[first], offset[last] + length


def _spans_of(segments: list[bytes], ids: np.ndarray, begin: np.ndarray, length: int) -> pa.RecordBatch:
    """Repeated spans among segments that begin at `begin` of documents `ids`."""
    # segments in the order of (did, start), spaced so that offsets don't reach the next document's
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    owner, offset = repeated_starts(segments, (rank << np.int64(42)) + begin, length)
    owner, low, high = _merged(owner, offset, length)
    at = np.cumsum([0] + [len(s) for s in segments])[owner]
    hashes = SpanHash(np.frombuffer(b"".join(segments), np.uint8)).of(at + low, at + high)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[owner]), pa.array(begin[owner] + low), pa.array(begin[owner] + high),
         pa.array(hashes.view(np.int64))], names=["did", "start", "end", "hash"])


def _by_suffix_arrays(regions: DataFrame, length: int) -> DataFrame:
    """Repeated spans among regions dealt out by anchor; a task sorts them in chunks of whole groups."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a chunk, cut between groups

        def spans() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            return _spans_of(whole["bytes"].to_pylist(), whole["did"].to_numpy(), whole["start"].to_numpy(), length)

        size, group = 0, None
        for b in batches:
            anchor = b["anchor"].to_numpy()
            heads = np.flatnonzero(np.append(group is None or anchor[0] != group, anchor[1:] != anchor[:-1]))
            total = np.concatenate(([0], np.cumsum([len(x.as_buffer()) for x in b["bytes"]])))
            cut = 0
            for head in heads.tolist():
                if size + total[head] - total[cut] >= CHUNK_BYTES:
                    held.append(b.slice(cut, head - cut))
                    yield spans()
                    held, size, cut = [], 0, head
            held.append(b.slice(cut))
            size, group = size + total[-1] - total[cut], anchor[-1]
        if held:
            yield spans()

    return regions.repartition("anchor").sortWithinPartitions("anchor", "did", "start").mapInArrow(find, SPAN)


def _by_strings(regions: DataFrame, length: int) -> DataFrame:
    """Repeated spans among the regions of crowded anchors, string by string."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_of(b["bytes"])
            begin = np.arange(max(len(data) - length + 1, 0))
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            begin = begin[owner[:len(begin)] == owner[length - 1:]] if len(begin) else begin
            of = owner[begin]
            yield pa.RecordBatch.from_arrays(
                [pa.array(SpanHash(data, seed).of(begin, begin + length).view(np.int64)) for seed in (0, 1)]
                + [pa.array(b["did"].to_numpy()[of]), pa.array(b["start"].to_numpy()[of] + begin - at[of])],
                names=["hash", "check", "did", "start"])

    found = regions.select("did", "start", "bytes").mapInArrow(
        strings, "hash bigint, check bigint, did bigint, start bigint").distinct()
    least = found.groupBy("hash", "check").agg(F.min(F.struct("did", "start")).alias("first"),
                                               F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(least, ["hash", "check"]).where(F.struct("did", "start") > F.col("first")).select(
        "did", "start", (F.col("start") + length).alias("end"), "hash")


class _Step:
    """A step's result, written; then the shuffle files of the steps before it may go."""

    def __init__(self, df: DataFrame, name: str):
        spark, schema = df.sparkSession, df.schema
        self.path = new_path(spark, name)
        df.write.parquet(self.path)
        del df
        gc.collect()
        spark._jvm.System.gc()
        self.table = spark.read.schema(schema).parquet(self.path)

    def remove(self) -> None:
        """To be called when all that was made of it is written."""
        spark = self.table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def repeated_spans(docs: DataFrame, length: int = LENGTH, group_regions: int = GROUP_REGIONS) -> DataFrame:
    """(did, start, end, hash): spans of documents whose every string of `length` starts earlier elsewhere.

    Spans overlap; their union is what repeats. `hash` is that of the span's bytes.
    """
    small_batches(docs.sparkSession)
    found = _instances(docs, length)
    often = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max(_twice("place")).alias("twice")).where(
        "n > 1 or twice").select("anchor")
    anchors = _Step(found.join(often, "anchor"), "anchors")
    shared = anchors.table

    here = F.struct("did", _start("place").alias("start"))
    regions = _Step(shared.groupBy("anchor", "region").agg(
        F.min(F.struct("did", "place")).alias("first"), F.count(F.lit(1)).alias("n")).select(
        "anchor", "region", "first.did", "first.place", "n"), "regions")
    kinds = regions.table
    earliest = kinds.where("n > 1").select(
        "anchor", "region", F.struct("did", _start("place").alias("start")).alias("at"))
    copies = _Step(shared.join(earliest, ["anchor", "region"]).where(here > F.col("at")).select(
        "did", _start("place").alias("start"), (_start("place") + _size("place")).alias("end"),
        F.col("region").alias("hash")), "copies")
    anchors.remove()

    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("regions"), F.max(_twice("place")).alias("twice")).where(
        "regions > 1 or twice").select("anchor", "regions")
    grouped = _Step(kinds.join(groups, "anchor").select("anchor", "region", "regions", "did", "place"), "wanted")
    regions.remove()
    wanted = grouped.table
    spans = _by_suffix_arrays(_cut(docs, wanted.where(F.col("regions") <= group_regions)), length)
    crowded = wanted.where(F.col("regions") > group_regions)
    if not crowded.isEmpty():
        spans = spans.union(_by_strings(_cut(docs, crowded), length))
    found = _Step(spans, "spans")
    grouped.remove()
    return found.table.union(copies.table)


def _gone(data: np.ndarray, at: np.ndarray, first: np.ndarray, spans: list[np.ndarray]) -> np.ndarray:
    """Which bytes of the texts their spans cover; `first` says where each text's spans begin."""
    start, end, wanted = spans
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    start, end = at[owner] + start, at[owner] + end
    fits = np.flatnonzero(end <= at[owner + 1])  # those of another text of the same id may not
    start, end = start[fits], end[fits]
    same = SpanHash(data).of(start, end).view(np.int64) == wanted[fits]
    change = np.bincount(start[same], minlength=len(data) + 1) - np.bincount(end[same], minlength=len(data) + 1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_regions: int = GROUP_REGIONS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; `kept` is the remaining bytes."""
    return _finished(docs, length, group_regions, "kept binary", lambda kept: pa.array(kept, pa.binary()))


def removal_digests(docs: DataFrame, length: int = LENGTH, group_regions: int = GROUP_REGIONS) -> DataFrame:
    """The same with `kept_sha256`, the lowercase hex digest of the remaining bytes, in place of them."""
    return _finished(docs, length, group_regions, "kept_sha256 string",
                     lambda kept: pa.array([hashlib.sha256(k).hexdigest() for k in kept]))


def _finished(docs: DataFrame, length: int, group_regions: int, column: str, value) -> DataFrame:
    rows = _documents(docs)
    spans = repeated_spans(rows, length, group_regions)
    lists = spans.groupBy("did").agg(F.collect_list(F.struct("start", "end", "hash")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (data, at), lists = text_of(b["raw"]), b["spans"]
            first = lists.offsets.to_numpy()
            spans = [lists.values.field(c).to_numpy() for c in ("start", "end", "hash")]
            for low, high in slices(at, SLICE_BYTES):
                part, cut = data[at[low]:at[high]], at[low:high + 1] - at[low]
                own = slice(first[low], first[high])
                gone = _gone(part, cut, first[low:high + 1], [c[own] for c in spans])
                total = np.concatenate(([0], np.cumsum(gone)))
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = cut[:-1][cut[:-1] < len(part)]
                begins[heads] = gone[heads]  # a run ends with its text
                runs = np.concatenate(([0], np.cumsum(begins)))
                kept = [part[x:y][~gone[x:y]].tobytes() if total[y] > total[x] else part[x:y].tobytes()
                        for x, y in zip(cut.tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(low, high - low), pa.array(np.diff(cut)), pa.array(np.diff(total[cut])),
                     pa.array(np.diff(runs[cut])), value(kept)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", column.split()[0]])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.join(lists, "did", "left").select("doc_id", "raw", "spans").mapInArrow(
        finish, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {column}")
