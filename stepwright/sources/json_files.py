"""JSON sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepwright.functions.text import strip
from stepwright.sources.json_arrays import CORRUPT, STRICT, once, read_json_arrays  # noqa: F401


def good_records(scan: DataFrame) -> DataFrame:
    return scan.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantined(scan: DataFrame) -> DataFrame:
    """The raw text that could not be decoded, with its file."""
    return scan.where(F.col(CORRUPT).isNotNull()).select("source_file", F.col(CORRUPT).alias("raw"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines; blank lines are skipped, malformed ones keep `_corrupt_record`."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("source_file"), F.col("value")).where(
        strip(F.col("value")) != "")
    parsed = F.from_json("value", T._parse_datatype_string(schema).add(CORRUPT, "string"), STRICT)
    return lines.select("source_file", once(parsed).alias("r")).select("r._v.*", "source_file")


def read_splits(spark: SparkSession, files: dict[str, str], schema: str) -> DataFrame:
    """Named JSON Lines sources as one table with their name in `split`."""
    parts = [spark.read.schema(schema).json(path).withColumn("split", F.lit(name))
             for name, path in files.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def write_json_lines(df: DataFrame, path: str, numbers: tuple[str, ...] = ()) -> None:
    """Replace `path` with one JSON object per line; text columns in `numbers` are written as the numbers they hold."""
    if not numbers:
        df.write.mode("overwrite").json(path)
        return
    line = F.to_json(F.struct("*"))
    for name in numbers:  # inside a string value the quotes would be escaped
        line = F.regexp_replace(line, rf'"{name}":"(-?[0-9][-+.0-9eE]*)"', rf'"{name}":$1')
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_by_file(df: DataFrame, path: str, *by: str) -> None:
    """One folder per value of `by`, each of JSON Lines; rebalanced to few, even files."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).json(path)


def write_json_arrays(df: DataFrame, path: str, rows_per_file: int = 20000) -> None:
    """JSON array files of at most `rows_per_file` elements, one element per line.

    Other readers parse such a file in one piece, so files are kept small. Rows
    stream through; one line is held back until it is known to be a file's last.
    """
    def as_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = None, 0
        for batch in batches:
            lines = []
            for element in batch["value"]:
                if held is not None:
                    full = count == rows_per_file
                    lines.append(held + ("]" if full else ","))
                    count = 0 if full else count
                held = element if count else "[" + element
                count += 1
            yield pd.DataFrame({"value": lines})
        if held is not None:
            yield pd.DataFrame({"value": [held + "]"]})

    rows = df.select(F.to_json(F.struct("*")).alias("value"))
    rows.mapInPandas(as_arrays, "value string").write.option(
        "maxRecordsPerFile", rows_per_file).mode("overwrite").text(path)
