"""Joins of days with the targets near them, by bands of days.

A row belongs to one band, as wide as the range around a target; a target's range touches two bands
at most. So the join key is (station, band), a target is copied twice rather than once a day, and
what meets under one key is bounded by the calendar: a band's days and the targets of two bands.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.constants import KEY

_BAND, _ROW_DAY, _TARGET_DAY = "_band", "_row_day", "_target_day"


def band_join(
    rows: DataFrame, targets: DataFrame, day: Column, target: Column, first: int, last: int, how: str = "inner"
) -> DataFrame:
    """Rows of the same station with target + first <= day <= target + last.

    `how` is inner (columns of the rows, then those of the targets but the station) or left_semi
    (each such row once). Both days are dates; a row or target without one meets nothing.
    """
    width = last - first + 1
    band = lambda number: F.floor(number / width).cast("int")
    left = rows.withColumn(_ROW_DAY, F.unix_date(day)).withColumn(_BAND, band(F.col(_ROW_DAY)))
    near = targets.withColumn(_TARGET_DAY, F.unix_date(target))
    touched = F.array_distinct(F.array(band(F.col(_TARGET_DAY) + first), band(F.col(_TARGET_DAY) + last)))
    right = near.withColumn(_BAND, F.explode(touched))
    if how == "left_semi":
        right = right.select(KEY, _BAND, _TARGET_DAY)
    a, b = left.alias("a"), right.alias("b")
    gap = F.col(f"a.{_ROW_DAY}") - F.col(f"b.{_TARGET_DAY}")
    same = (F.col(f"a.{KEY}") == F.col(f"b.{KEY}")) & (F.col(f"a.{_BAND}") == F.col(f"b.{_BAND}"))
    met = a.join(b, same & gap.between(first, last), how)
    added = [c for c in targets.columns if c != KEY] if how == "inner" else []
    return met.select(*[F.col(f"a.{c}") for c in rows.columns], *[F.col(f"b.{c}") for c in added])
