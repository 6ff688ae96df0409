"""Statistics of array columns without NULLs, as built-in higher-order functions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def array_std(values: Column) -> Column:
    squares = let(
        array_mean(values),
        lambda m: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)),
    )
    return F.sqrt(squares / (F.size(values) - 1))
