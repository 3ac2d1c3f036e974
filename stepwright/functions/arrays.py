"""Two small tools for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value computed once; an expression inside a lambda runs per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_rows(array: Column) -> Column:
    """An array column made ready to explode.

    Exploding a bare column adds a size filter that is pushed down through the
    projections that compute the column, and so computes it again; exploding an
    expression does not.
    """
    return F.slice(array, F.lit(1), F.size(array))
