"""Judge templates as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.functions.prompts import RUBRIC_FILES, RUBRICS


def default_rubrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RUBRICS.items()), "metric string, template string")


def read_rubrics(spark: SparkSession, folder: str) -> DataFrame:
    """(metric, template) from the eight template files under a folder, read once."""
    metric = F.create_map(*[F.lit(x) for m, f in RUBRIC_FILES.items() for x in (f, m)])
    file = F.regexp_extract("_metadata.file_path", r"(check_[a-z_]+\.txt)", 1)
    return (
        spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
        .select(F.try_element_at(metric, file).alias("metric"), F.col("value").alias("template"))
        .where(F.col("metric").isNotNull())
    )


def write_rubrics(rubrics: DataFrame, folder: str) -> None:
    """Write (metric, template) rows, one folder per file name; a line end closes each text."""
    file = F.create_map(*[F.lit(x) for m, f in RUBRIC_FILES.items() for x in (m, f)])
    rubrics.select(F.try_element_at(file, F.col("metric")).alias("file"), "template").write.mode(
        "overwrite").partitionBy("file").text(folder)
