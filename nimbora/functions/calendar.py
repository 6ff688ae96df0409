"""Calendar columns of a date."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CALENDAR = {
    "day_of_year": F.dayofyear,
    "week_of_year": F.weekofyear,  # ISO week
    "month": F.month,
    "year": F.year,
    "quarter": F.quarter,
}


def calendar_columns(names: Sequence[str], date: Column) -> list[Column]:
    """One int column per requested name, named after it."""
    unknown = set(names) - set(CALENDAR)
    if unknown:
        raise ValueError(f"unknown calendar columns: {sorted(unknown)}")
    return [CALENDAR[name](date).cast("int").alias(name) for name in names]
