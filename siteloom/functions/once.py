"""A value that an expression reads several times, written into the plan and worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written into the plan once however often body uses it.

    The value is the start of a sum over nothing, and body its end. An item of a transformed list would ask body for its type with every
    row, and body the values within it.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda start, _: start, body)


def found(value: Column, rule: Callable[[Column], Column]) -> Column:
    """The value as a row's own, where it meets the rule; other rows go. A filter beside the value would work it out again for each of its conditions."""
    return F.explode(F.filter(F.array(value), rule))
