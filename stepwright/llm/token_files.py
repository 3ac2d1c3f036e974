"""Token ids in compressed blocks: one zstandard frame per document, one dictionary for all.

A written folder holds
  dictionary/  one row: sha256 of the trained dictionary, and its bytes
  blocks/      rows of up to BLOCK_BYTES: part and block number, the dictionary's
               sha256, bytes per id (2 or 4), ids before the block in its part,
               the doc_ids, the offset index (n + 1 unsigned 64-bit places in the
               payload), and the payload, the frames one after the other
Blocks of a part, and parts, are in ascending order of ids. To read one document
only its frame is decompressed: `Reader.get`.

Frames hold little-endian ids of the tokenizer, each document closed by `end_id`.
The dictionary is trained on the serialized ids of at most SAMPLE_DOCS documents:
all ids of those with up to SAMPLE_IDS, of longer ones so many in pieces taken at
even distances from beginning to end; where they are too few to train on, frames stand without a
dictionary and its sha256 is that of no bytes.

Nulls and odd rows: a null text has the end id only; null ids come first; equal
ids are put in order of a hash of their text. An empty table gives a folder without blocks.
Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.llm.common import starts
from stepwright.llm.tokens import encoder

BLOCK_BYTES = 1 << 18
SAMPLE_DOCS = 512
SAMPLE_IDS = 4096
PIECE_IDS = 256
DICTIONARY_BYTES = 1 << 16
LEVEL = 3

BLOCK = ("part int, block int, dictionary_sha256 string, width int, tokens_before bigint, n_tokens bigint, "
         "doc_ids array<bigint>, offsets binary, payload binary")


def serialise(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def parse(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype(np.uint32)


def _width(path: str, end_id: int) -> int:
    return 2 if max(encoder(path).vocabulary(), end_id + 1) <= 1 << 16 else 4


def _encoded(text: str | None, path: str, end_id: int) -> np.ndarray:
    ids = encoder(path).ids(text) if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(end_id))


def _sample(ids: np.ndarray) -> np.ndarray:
    """All of a document's ids, or pieces spread evenly over the whole of it."""
    if len(ids) <= SAMPLE_IDS:
        return ids
    begins = np.linspace(0, len(ids) - PIECE_IDS, SAMPLE_IDS // PIECE_IDS).astype(np.int64)
    return ids[begins[:, None] + np.arange(PIECE_IDS)].ravel()


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """Dictionary from a bounded sample, the documents whose hashed ids are least; b'' if it is too small."""
    width = _width(path, end_id)
    order = F.xxhash64("doc_id", F.lit(7))
    keys = docs.select(order.alias("_key")).distinct().orderBy("_key").limit(SAMPLE_DOCS)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [serialise(_sample(_encoded(t.as_py(), path, end_id)), width) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(raw, pa.binary())], names=["_key", "raw"])

    picked = docs.select(order.alias("_key"), "text").join(F.broadcast(keys), "_key").mapInArrow(
        sample, "_key bigint, raw binary")
    # rows of one id, if many, are cut back to the bound after they were ordered
    samples = [bytes(r.raw) for r in picked.orderBy("_key", "raw").limit(SAMPLE_DOCS).collect()]
    if sum(map(len, samples)) < 8 * 1024 or len(samples) < 8:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode every document, in ascending order of ids, to a new folder `path`.

    One range shuffle moves the texts; a task writes its blocks as it goes and
    holds one at a time. Parts are committed by Spark's writer, so a task that
    runs twice leaves its blocks once.
    """
    spark = docs.sparkSession
    width, dictionary = _width(tokenizer_path, end_id), train_dictionary(docs, tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(
        1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False)
        part, block, before = 0, 0, 0
        doc_ids: list = []
        frames: list[bytes] = []
        size = tokens = 0

        def row() -> pa.RecordBatch:
            offsets = np.array(starts([len(f) for f in frames]), "<u8").tobytes()
            values = [part, block, digest, width, before, tokens, doc_ids, offsets, b"".join(frames)]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
                     pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            for n, doc_id, text in zip(b["_part"].to_pylist(), b["doc_id"].to_pylist(), b["text"]):
                part = n
                ids = _encoded(text.as_py(), tokenizer_path, end_id)
                frames.append(pack.compress(serialise(ids, width)))
                doc_ids.append(doc_id)
                size, tokens = size + len(frames[-1]) + 16, tokens + len(ids)
                if size >= BLOCK_BYTES:
                    yield row()
                    block, before, doc_ids, frames, size, tokens = block + 1, before + tokens, [], [], 0, 0
        if frames:
            yield row()

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.xxhash64("text").alias("_tie"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.spark_partition_id().alias("_part"), "doc_id", "text").mapInArrow(blocks, BLOCK).write.parquet(
        f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    found = bytes(row.dictionary)
    if hashlib.sha256(found).hexdigest() != row.sha256:
        raise ValueError(f"the dictionary in {path} is not the one it was written with")
    return row.sha256, found


class Reader:
    """Documents of one block; each is decompressed alone."""

    def __init__(self, dictionary: bytes, width: int, offsets: bytes, payload: bytes):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared)
        self.width, self.offsets, self.payload = width, np.frombuffer(offsets, "<u8").astype(np.int64), payload

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def get(self, i: int) -> np.ndarray:
        return parse(self.unpack.decompress(self.payload[self.offsets[i]:self.offsets[i + 1]]), self.width)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; `start` counts the ids of all documents before it."""
    return _read(spark, path, "ids array<bigint>", lambda ids: pa.array([x.tolist() for x in ids],
                                                                       pa.list_(pa.int64())))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; the crc is over ids as unsigned 32-bit numbers."""
    return _read(spark, path, "ids_crc32 bigint",
                 lambda ids: pa.array([crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _read(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    digest, dictionary = read_dictionary(spark, path)
    table = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # one number for each part, of which there are as many as shuffle partitions
    found = {r[0]: r[1] for r in table.groupBy("part").agg(F.sum("n_tokens")).collect()}
    base = starts([found.get(i, 0) for i in range(max(found, default=-1) + 1)])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                if b["dictionary_sha256"][i].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                reader = Reader(dictionary, b["width"][i].as_py(), b["offsets"][i].as_py(), b["payload"][i].as_py())
                ids = [reader.get(k) for k in range(len(reader))]
                sizes = np.array([len(x) for x in ids], np.int64)
                begin = base[b["part"][i].as_py()] + b["tokens_before"][i].as_py() + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [b["doc_ids"].slice(i, 1).flatten(), pa.array(begin), pa.array(sizes), value(ids)],
                    names=["doc_id", "start", "n_tokens", column.split()[0]])

    return table.mapInArrow(documents, f"doc_id bigint, start bigint, n_tokens bigint, {column}")
