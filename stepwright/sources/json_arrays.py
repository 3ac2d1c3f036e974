"""JSON array files of any size, read by as many tasks as the file has blocks.

The text source cuts a file at every opening brace, in blocks as Spark splits files.
A piece begins after a brace, so nothing is escaped there: what a block does to the
reader is to change whether it is inside a string, and the depth. Both, and the
commas at each depth, are found for either beginning in a first scan; running sums
over a file's blocks tell each block how it begins and how many elements came
before. A second scan cuts the blocks at the commas of the outer array. Elements
that lie in one block are parsed there; of each block the first and the last piece
of an element are put together with their neighbours'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwright.sources.workspace import written

CORRUPT = "_corrupt_record"

# Python's JSON reader takes no single quotes
STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "columnNameOfCorruptRecord": CORRUPT}

_CUT = b"{"
_BLANKS = b" \t\n\r"
_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = b'"\\,[]'
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_STRUCTURE = np.zeros(256, bool)
_STRUCTURE[[ord(c) for c in "[]{},"]] = True


class Marks:
    """The quotes and structural characters of a stretch of text that begins unescaped."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        quotes = np.flatnonzero(data == _QUOTE)
        if len(quotes) and _BACKSLASH in text:
            plain = np.where(data == _BACKSLASH, -1, np.arange(len(data)))
            before = np.concatenate(([-1], np.maximum.accumulate(plain)))[quotes]  # the last that is no backslash
            quotes = quotes[(quotes - 1 - before) % 2 == 0]
        self.flips = len(quotes) % 2
        self.places = np.flatnonzero(_STRUCTURE[data])
        self.signs = data[self.places]
        self.odd = np.searchsorted(quotes, self.places) % 2 == 1

    def outside(self, inside: bool) -> np.ndarray:
        """Which of the structural characters are in no string, if the text begins inside of one or not."""
        return self.odd if inside else ~self.odd


def _stretches(b: pa.RecordBatch) -> Iterator[tuple[tuple, int, bytes]]:
    """Block, first row and text of each run of pieces of one block, without the brace before the first."""
    paths, begins = b["path"].to_pylist(), b["start"].to_pylist()
    values = b["value"].to_pylist()
    first = 0
    for i in range(1, len(paths) + 1):
        if i == len(paths) or begins[i] != begins[first] or paths[i] != paths[first]:
            yield (paths[first], begins[first]), first, _CUT.join(values[first:i])
            first = i


def _effects(pieces: DataFrame) -> DataFrame:
    """Per block: its effect for either beginning, its first character that isn't blank, and its bytes.

    Of a block that comes in several batches there are several rows, by `part`.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, 0
        for b in batches:
            rows: list[tuple] = []
            for block, _, text in _stretches(b):
                part = part + 1 if block == last else 0
                if block[1] or part:
                    text = _CUT + text
                last, marks = block, Marks(text)
                effects = []
                for inside in (False, True):
                    out = marks.outside(inside)
                    depth = np.cumsum(_STEP[marks.signs[out]])
                    levels, counts = np.unique(depth[marks.signs[out] == _COMMA], return_counts=True)
                    effects += [int(depth[-1]) if len(depth) else 0, list(zip(levels.tolist(), counts.tolist()))]
                rows.append((*block, part, bool(marks.flips), *effects, text.lstrip(_BLANKS)[:1]))
            columns = list(zip(*rows))
            level = pa.map_(pa.int64(), pa.int64())
            types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), level, pa.int64(), level, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[
                "path", "start", "part", "flips", "out_depth", "out_commas", "in_depth", "in_commas", "root"])

    return pieces.select("value", "path", "start").mapInArrow(
        measure, "path string, start bigint, part int, flips boolean, out_depth bigint, out_commas map<bigint,bigint>, "
                 "in_depth bigint, in_commas map<bigint,bigint>, root binary")


def _states(effects: DataFrame) -> DataFrame:
    """How each part of a block begins: inside of a string or not, its depth, the outer commas before it."""
    order = Window.partitionBy("path").orderBy("start", "part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def so_far(value: Column) -> Column:
        return F.coalesce(F.sum(value).over(before), F.lit(0))

    inside = effects.withColumn("inside", so_far(F.col("flips").cast("int")) % 2 == 1)
    picked = inside.withColumns({
        "change": F.when(F.col("inside"), F.col("in_depth")).otherwise(F.col("out_depth")),
        "levels": F.when(F.col("inside"), F.col("in_commas")).otherwise(F.col("out_commas"))})
    deep = picked.withColumn("depth", so_far(F.col("change")))
    # a comma of the outer array is at depth 1
    outer = F.coalesce(F.try_element_at("levels", 1 - F.col("depth")), F.lit(0))
    return deep.withColumn("outer", outer).withColumn("done", so_far(F.col("outer")))


def _segments(pieces: DataFrame, states: DataFrame, columns: list[str]) -> DataFrame:
    """The elements, or the pieces of them, with their place in the array.

    `edge` is the block of a piece that may go on in another block, and null for a
    whole element. `bad` marks text before or behind the array.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    known = F.broadcast(states.where("start > 0 and part = 0").select(
        "path", "start", "inside", "depth", "done"))  # one row for each full split, however many files there are
    joined = pieces.join(known, ["path", "start"], "left")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, depth, number, own, held = None, False, 0, 0, 0, []
        fresh = False  # nothing but blanks so far in this file
        names: list = []

        def piece(text: bytes, edge: bool) -> tuple:
            return names, number, block[1] if edge else None, text, False

        def packed(found: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
            fixed = [pa.array([f[0][i] for f in found], b.schema.field(c).type) for i, c in enumerate(columns)]
            rest = [pa.array([f[i] for f in found], t) for i, t in
                    ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()), (4, pa.bool_()))]
            return pa.RecordBatch.from_arrays(fixed + rest, names=[*columns, "idx", "edge", "text", "bad"])

        for b in batches:
            found: list[tuple] = []
            for at, first, text in _stretches(b):
                began = at != block
                if began:
                    if block is not None:
                        found.append(piece(b"".join(held), True))
                    block, held, own = at, [], 0
                    names = [b[c][first].as_py() for c in columns]
                    if at[1] == 0:
                        inside, depth, number, fresh = False, 0, 1, True
                    elif b["inside"][first].as_py() is None:
                        raise RuntimeError(f"{at[0]} was split differently by a second reading; read it once more")
                    else:
                        inside, depth, fresh = b["inside"][first].as_py(), b["depth"][first].as_py(), False
                        number = b["done"][first].as_py() + 1
                text = text if began and at[1] == 0 else _CUT + text
                marks = Marks(text)
                out = marks.outside(inside)
                places, signs = marks.places[out], marks.signs[out]
                steps = _STEP[signs]
                after = depth + np.cumsum(steps)
                # outer commas, the array's own brackets, and what comes at depth 0
                opened = np.flatnonzero((signs == _OPEN) & (after == 1))
                closed = np.flatnonzero((signs == _CLOSE) & (after == 0))
                commas = places[(signs == _COMMA) & (after == 1)]
                start = 0
                if depth == 0:
                    if fresh and len(opened):
                        start, fresh = int(places[opened[0]]) + 1, False
                        lead = text[:start - 1]
                    else:
                        start, lead = len(text), text
                    if lead.strip(_BLANKS):
                        found.append((names, None, block[1], b"", True))
                end = int(places[closed[0]]) if len(closed) else len(text)
                if len(closed) and text[end + 1:].strip(_BLANKS):
                    found.append((names, None, block[1], b"", True))
                for comma in commas[(commas >= start) & (commas < end)].tolist():
                    held.append(text[start:comma])
                    found.append(piece(b"".join(held), own == 0 and block[1] > 0))
                    held, start, number, own = [], comma + 1, number + 1, own + 1
                held.append(text[start:end])
                inside ^= bool(marks.flips)
                depth = int(after[-1]) if len(after) else depth
            if found:
                yield packed(found, b)
        if block is not None:
            yield packed([piece(b"".join(held), True)], b)

    return joined.select(*columns, "start", "inside", "depth", "done", "value").mapInArrow(
        cut, f"{schema}, idx bigint, edge bigint, text binary, bad boolean")


def _whole_blocks(pieces: DataFrame, columns: list[str]) -> DataFrame:
    """The text of each block, in one value."""
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, held = None, [], []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([n], kind) for n, kind in zip(names, types)] + [pa.array([b"".join(held)], pa.binary())],
                names=[*columns, "text"])

        for b in batches:
            types = [b.schema.field(c).type for c in columns]
            for at, first, text in _stretches(b):
                if at != block:
                    if block is not None:
                        yield packed()
                    block, names, held = at, [b[c][first].as_py() for c in columns], []
                held.append(text if not held and at[1] == 0 else _CUT + text)
        if block is not None:
            yield packed()

    return pieces.select(*columns, "start", "value").mapInArrow(
        join, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", text binary")


def once(value: Column) -> Column:
    """A value as a generator's only row (`_v`): a filter on it isn't pushed below, which would compute it twice."""
    return F.explode(F.array(F.struct(value.alias("_v"))))


def read_json_arrays(spark: SparkSession, folder: str, schema: str, glob: str = "*.json") -> DataFrame:
    """Records of all JSON array files directly in `folder`, with `source_file` and `idx`.

    `idx` is the 1-based position in the file, given before any filter. A file that
    is not one array, all of whose elements can be parsed, gives no records but its
    text in `_corrupt_record`, a row for each of its blocks as Spark splits files; see
    `good_records` and `quarantined`. Spark passes over files of no bytes. Each record is
    parsed once; the records are written to the shared folder. A null element
    gives no row, but is counted.
    """
    fields = T._parse_datatype_string(schema)
    files = spark.read.option("pathGlobFilter", glob).text(folder, lineSep=_CUT.decode())
    folders = [c for c in files.columns if c != "value"]
    place = {"path": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start"),
             "source_file": F.col("_metadata.file_name")}
    pieces = files.select(*folders, *[c.alias(n) for n, c in place.items()], F.col("value").cast("binary").alias("value"))
    columns = ["path", "source_file", *folders]

    states = written(_states(_effects(pieces)), "array-blocks")
    # of every file: whether its array or a string in it is never closed, or nothing is there at all
    ends = states.groupBy("path").agg(
        ((F.sum("change") != 0) | (F.count_if("flips") % 2 == 1) | ~F.bool_or(F.col("root") != F.lit(b""))).alias("open"))

    def parsed(rows: DataFrame) -> DataFrame:
        text = F.col("text").cast("string")
        value = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(fields), STRICT)
        whole = rows.select("*", once(F.when(F.col("edge").isNull() & ~F.col("bad"), value)).alias("_p"))
        blank = F.btrim(text, F.lit(_BLANKS.decode())) == ""
        return whole.select(
            *columns, "idx", "edge", F.when(F.col("edge").isNotNull(), F.col("text")).alias("text"),
            (F.col("bad") | F.col("edge").isNull() & ~blank & (F.coalesce(F.size("_p._v"), F.lit(0)) != 1)).alias("bad"),
            (F.col("edge").isNull() & blank).alias("blank"), F.get("_p._v", F.lit(0)).alias("_r"))

    segments = written(parsed(_segments(pieces, states, columns)), "array-elements")
    # two pieces of each block at most
    pieces_of = F.array_sort(F.collect_list(F.struct("edge", "text")))
    joined = segments.where("edge is not null and not bad").groupBy(*columns, "idx").agg(pieces_of.alias("_e")).select(
        *columns, "idx", F.lit(None).cast("bigint").alias("edge"),
        F.aggregate("_e.text", F.lit(b""), lambda a, x: F.concat(a, x)).alias("text"), F.lit(False).alias("bad"))
    records = segments.where("edge is null or bad").unionByName(parsed(joined))
    # an element may be blank only if it is the only one
    wrong = F.max(F.col("bad")) | (F.count_if("blank") > 0) & (F.count(F.lit(1)) > 1)
    bad = records.groupBy("path").agg(wrong.alias("wrong")).join(ends, "path", "full").where(
        F.coalesce("wrong", F.lit(False)) | F.col("open")).select("path")
    bad = written(bad, "bad-arrays")

    names = [f.name for f in fields.fields]
    good = records.where(F.col("_r").isNotNull()).join(bad, "path", "left_anti").select(
        *folders, "source_file", "idx", "_r.*", F.lit(None).cast("string").alias(CORRUPT))

    def unread(rows: DataFrame) -> DataFrame:
        return rows.select(
            *folders, "source_file", F.lit(None).cast("bigint").alias("idx"),
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields.fields], F.col("text").cast("string").alias(CORRUPT))

    assert good.columns == [*folders, "source_file", "idx", *names, CORRUPT]
    if not bad.isEmpty():
        good = good.union(unread(_whole_blocks(pieces, columns).join(bad, "path", "left_semi")))
    return good
