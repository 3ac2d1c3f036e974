"""The given parquet tables, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, read as it lies; the size of a scan's tasks is a setting of the session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream, be it one file or a folder of parts."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a glob lets a single file stand where the source expects a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
