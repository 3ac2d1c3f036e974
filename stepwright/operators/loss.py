"""Loss audit on logged token signals.

Input rows are tokens: (batch_id, shard, prompt_id, gen, pos, mask, adv, logp,
old_logp, ref_logp, entropy). Sums combine map-side, so a batch or sequence of
any size costs one shuffled row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from stepwright.sources.workspace import written

SEQUENCE = ["batch_id", "prompt_id", "gen"]


@dataclass(frozen=True)
class LossParams:
    epsilon_low: float = 0.2
    epsilon_high: float = 0.2
    beta: float = 0.05


def ratio() -> Column:
    return F.exp(F.col("logp") - F.col("old_logp"))


def kl() -> Column:
    """Always non-negative estimate of the divergence from the reference policy."""
    gap = F.col("ref_logp") - F.col("logp")
    return F.exp(gap) - gap - 1


def token_loss(p: LossParams, entropy_mask: Column | None = None) -> Column:
    """Clipped surrogate loss of a token plus its weighted divergence."""
    clipped = F.least(F.greatest(ratio(), F.lit(1 - p.epsilon_low)), F.lit(1 + p.epsilon_high))
    loss = -F.least(ratio() * F.col("adv"), clipped * F.col("adv"))
    if entropy_mask is not None:
        loss = loss * entropy_mask
    return loss + F.lit(p.beta) * kl() if p.beta != 0.0 else loss


def masked_mean(value: Column) -> Column:
    """Sum over unmasked tokens by their number, at least one."""
    return F.sum(value * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))


def sequence_loss(tokens: DataFrame, p: LossParams = LossParams(),
                  entropy_mask: Column | None = None) -> DataFrame:
    return tokens.groupBy(*SEQUENCE).agg(masked_mean(token_loss(p, entropy_mask)).alias("loss"))


def batch_loss(tokens: DataFrame, p: LossParams = LossParams(),
               entropy_mask: Column | None = None) -> DataFrame:
    """Mean over sequences of their masked mean loss."""
    return sequence_loss(tokens, p, entropy_mask).groupBy("batch_id").agg(
        F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("sequences"))


def across_shards(per_shard: DataFrame, aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """Combine shard metrics per batch; a NaN shard is skipped, not the largest."""
    fn = {"mean": F.avg, "min": F.min, "max": F.max}
    return per_shard.groupBy("batch_id").agg(*[
        fn[how](F.when(~F.isnan(source), F.col(source))).alias(name)
        for name, (source, how) in aggregates.items()])


def shard_means(tokens: DataFrame, p: LossParams = LossParams()) -> DataFrame:
    """(batch_id, shard, kl, entropy, low, high, region): what the audits below combine, by one pass over the tokens.

    They take tokens as well as these means; several of them share the pass if the means are written.
    """
    low = (ratio() < 1 - p.epsilon_low) & (F.col("adv") < 0)
    high = (ratio() > 1 + p.epsilon_high) & (F.col("adv") > 0)
    return tokens.groupBy("batch_id", "shard").agg(
        masked_mean(kl()).alias("kl"), masked_mean(F.col("entropy")).alias("entropy"),
        masked_mean(low.cast("double")).alias("low"), masked_mean(high.cast("double")).alias("high"),
        masked_mean((low | high).cast("double")).alias("region"))


def _means_of(tokens: DataFrame, p: LossParams = LossParams()) -> DataFrame:
    return shard_means(tokens, p) if "mask" in tokens.columns else tokens


def kl_stats(tokens: DataFrame) -> DataFrame:
    return across_shards(_means_of(tokens), {"kl": ("kl", "mean")})


def entropy_stats(tokens: DataFrame) -> DataFrame:
    return across_shards(_means_of(tokens), {"entropy": ("entropy", "mean")})


def clip_ratios(tokens: DataFrame, p: LossParams = LossParams()) -> DataFrame:
    """Share of tokens whose ratio was clipped, below and above, per batch over its shards."""
    return across_shards(_means_of(tokens, p), {
        "low_mean": ("low", "mean"), "low_min": ("low", "min"),
        "high_mean": ("high", "mean"), "high_max": ("high", "max"),
        "region_mean": ("region", "mean")})


def entropy_thresholds(tokens: DataFrame, quantile: float, bin_width: float = 2.0 ** -10) -> DataFrame:
    """Exact interpolated entropy quantile of the unmasked tokens of each batch; entropies that are NaN don't count.

    Cells of fixed width are counted, which combines before the shuffle, to find
    those that hold the two ranks the quantile falls between. Only their values are
    read again: these cells are cut into 2^14 finer ones, twice, and what is left in
    the last cells is ranked one by one, so values that crowd near zero, as those of
    a trained model do, are no single group. All tokens are read twice, and only
    those of the first cells leave their task.
    """
    values = written(tokens.where((F.col("mask") == 1) & F.col("entropy").isNotNull() & ~F.isnan("entropy")).select(
        "batch_id", "entropy"), "entropies")
    lower, upper = F.floor("rank"), F.ceil("rank")

    def holds(r: Column) -> Column:
        return (F.col("before") <= r) & (r < F.col("before") + F.col("n"))

    def chosen(counts: DataFrame, *key: str) -> DataFrame:
        """Of the counted cells within `key` those that hold a wanted rank, and how many values come before each."""
        upto = F.sum("n").over(Window.partitionBy(*key).orderBy("finer").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("before", F.col("before") + upto - F.col("n"))
        return written(found.where(holds(lower) | holds(upper)).select(
            "batch_id", F.col("finer").alias("cell"), "before", "rank"), "cells")

    def inside_of(values: DataFrame, cells: DataFrame, width: float) -> DataFrame:
        cell = F.floor(F.col("entropy") / F.lit(width))
        return values.select("batch_id", "entropy", cell.alias("cell")).join(cells, ["batch_id", "cell"])

    def counted(values: DataFrame, width: float, *key: str) -> DataFrame:
        return values.groupBy(*key, F.floor(F.col("entropy") / F.lit(width)).alias("finer")).agg(
            F.count(F.lit(1)).alias("n"))

    first = written(counted(values, bin_width, "batch_id"), "cell-counts")
    ranks = first.groupBy("batch_id").agg(
        ((F.sum("n") - 1) * F.lit(quantile)).alias("rank"), F.lit(0).cast("bigint").alias("before"))
    inside = written(inside_of(values, chosen(first.join(ranks, "batch_id"), "batch_id"), bin_width), "inside")
    key = ["batch_id", "cell"]
    for width in (bin_width * 2.0 ** -14, bin_width * 2.0 ** -28):
        cells = chosen(counted(inside, width, *key, "rank", "before"), *key)
        inside = inside_of(inside, cells, width)
    same = inside.groupBy(*key, "rank", "before", "entropy").agg(F.count(F.lit(1)).alias("n"))
    ranked = same.withColumn("last", F.col("before") - 1 + F.sum("n").over(
        Window.partitionBy(*key).orderBy("entropy").rowsBetween(Window.unboundedPreceding, 0)))
    at_lower = F.min(F.when(F.col("last") >= lower, F.col("entropy")))
    at_upper = F.min(F.when(F.col("last") >= upper, F.col("entropy")))
    share = F.max(F.col("rank") - lower)
    return ranked.groupBy("batch_id").agg(
        (at_lower + (at_upper - at_lower) * share).alias("threshold"))


def with_entropy_mask(tokens: DataFrame, top_quantile: float) -> DataFrame:
    """Mark the unmasked tokens at or above the (1 - top_quantile) entropy quantile; an entropy of NaN is never marked."""
    thresholds = entropy_thresholds(tokens, 1 - top_quantile)
    joined = tokens.join(thresholds, "batch_id", "left")
    keep = (F.col("mask") == 1) & (F.col("entropy") >= F.col("threshold")) & ~F.isnan("entropy")
    return joined.withColumn("entropy_mask", F.coalesce(keep, F.lit(False)).cast("int"))
