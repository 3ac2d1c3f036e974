"""Reasoning text to steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.functions.text import STEP_SEPARATOR, strip

MAX_STEPS = 5  # fixed value: steps kept per reasoning path


def split_process(process: Column) -> Column:
    """Non-blank steps of a separator-joined process."""
    pieces = F.transform(F.split(process, r"\n{5}"), strip)
    return F.filter(pieces, lambda s: s != "")


def join_steps(thoughts: Column) -> Column:
    """Number the thoughts and join them into one process text."""
    numbered = F.transform(
        thoughts, lambda t, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "),
                                        F.coalesce(t, F.lit(""))))
    return strip(F.array_join(numbered, STEP_SEPARATOR))


def earlier_steps(steps: Column, position: Column, separator: str) -> Column:
    """Context of a step: all steps before `position` (0-based), each closed by `separator`."""
    before = F.slice(steps, F.lit(1), position)
    return F.array_join(F.transform(before, lambda s: F.concat(s, F.lit(separator))), "")


def with_completion_steps(df: DataFrame, text: str, out: str = "steps") -> DataFrame:
    """Add the steps of a completion, at most five, cut at its `Step N:` markers.

    The markers 1, 2, 3, ... are taken greedily in order; markers in between
    stay inside the running step. Without a `Step 1:` the first five markers
    count. The last step ends at the next marker of any kind. A text without
    markers is one step.
    """
    segments = F.filter(F.split(F.col(text), r"(?=Step [0-9]+:)"),
                        lambda s: s.rlike(r"^Step [0-9]+:"))
    numbers = F.transform("_segments", lambda s: F.regexp_extract(
        s, r"^Step ([0-9]+):", 1).try_cast("decimal(38,0)"))
    # Positions of the markers 1..5 in order: each is the first one after its predecessor.
    in_order = F.aggregate(
        F.transform("_numbers", lambda n, i: F.struct(n.alias("n"), i.alias("i"))),
        F.array().cast("array<int>"),
        lambda taken, m: F.when(
            (F.size(taken) < MAX_STEPS) & (m["n"] == F.size(taken) + 1),
            F.array_append(taken, m["i"])).otherwise(taken),
    )
    first_five = F.slice(F.transform("_numbers", lambda n, i: i), 1, MAX_STEPS)
    chosen = F.when(F.size("_in_order") > 0, F.col("_in_order")).otherwise(first_five)

    def step_text(start: Column, k: Column) -> Column:
        following = F.get(F.col("_chosen"), k + 1)
        length = F.coalesce(following - start, F.lit(1))
        return strip(F.array_join(F.slice(F.col("_segments"), start + 1, length), ""))

    steps = F.when(F.size("_segments") == 0, F.array(strip(F.col(text)))).otherwise(
        F.transform("_chosen", step_text))
    return (
        df.withColumn("_segments", segments)
        .withColumn("_numbers", numbers)
        .withColumn("_in_order", in_order)
        .withColumn("_chosen", chosen)
        .withColumn(out, steps)
        .drop("_segments", "_numbers", "_in_order", "_chosen")
    )
