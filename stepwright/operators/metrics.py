"""Metric rollups over logged metric points (mode, step, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.operators.skew import running_sum

LOGGING_STEPS = 8  # fixed value: steps per logging interval


def logged_name(mode: Column, metric: Column) -> Column:
    return F.when(mode == "eval", F.concat(F.lit("eval_"), metric)).otherwise(metric)


def metric_rollup(points: DataFrame, every: int = LOGGING_STEPS) -> DataFrame:
    """Mean of each metric per logging interval; intervals without points are absent."""
    return points.groupBy(
        "mode", F.floor(F.col("step") / every).alias("interval"),
        logged_name(F.col("mode"), F.col("metric")).alias("metric"),
    ).agg(F.avg("value").alias("value"), F.count("value").alias("points"))


def tokens_seen(batches: DataFrame) -> DataFrame:
    """Tokens consumed up to and with each training step."""
    steps = batches.where(F.col("mode") == "train").groupBy("step").agg(F.sum("tokens").alias("tokens"))
    return running_sum(steps, [], "step", F.col("tokens"), "tokens_seen")


# The names that audits of a batch are logged under, by their column.
AUDIT_NAMES = {
    "mean_length": "completions/mean_length", "min_length": "completions/min_length",
    "max_length": "completions/max_length", "clipped_ratio": "completions/clipped_ratio",
    "mean_terminated_length": "completions/mean_terminated_length",
    "min_terminated_length": "completions/min_terminated_length",
    "max_terminated_length": "completions/max_terminated_length",
    "token_mean": "reward/token_mean", "token_std": "reward/token_std", "frac_zero_std": "reward/frac_zero_std",
    "kl": "kl", "entropy": "entropy", "low_mean": "clip_ratio/low_mean", "low_min": "clip_ratio/low_min",
    "high_mean": "clip_ratio/high_mean", "high_max": "clip_ratio/high_max", "region_mean": "clip_ratio/region_mean",
}


def audit_points(audits: list[DataFrame], step: str = "batch_id") -> DataFrame:
    """(step, metric, value) of all columns of the audits that are logged, to be rolled up with their mode."""
    points = None
    for audit in audits:
        known = [c for c in audit.columns if c in AUDIT_NAMES]
        rows = audit.select(F.col(step).alias("step"), F.explode(F.array(*[
            F.struct(F.lit(AUDIT_NAMES[c]).alias("metric"), F.col(c).cast("double").alias("value")) for c in known]
        )).alias("m")).select("step", "m.*")
        points = rows if points is None else points.unionByName(rows)
    return points
