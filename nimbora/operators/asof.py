"""Date-based features: a lag is an exact date, a frame is the days [x - n, x)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.constants import DATE, KEY
from nimbora.functions.calendar import calendar_columns
from nimbora.operators.bands import band_join
from nimbora.operators.blocks import (
    BLOCK,
    block_window,
    day_number,
    into_blocks,
    owned,
)
from nimbora.operators.bulk import AGGREGATES
from nimbora.operators.specs import LAG, Spec, base_columns, max_window

_DAY = "_day"
_ROW = "_row"  # 1 for a row of the history, NULL for a date that is only asked about


def asof_column(spec: Spec, order: Window) -> Column:
    """Window expression of one spec over history rows strictly before the date.

    No row in the frame gives 0. Sample std needs two rows, else 0. A row that is there
    but has no value gives NULL, as opposed to a row that is absent.
    """
    value = F.col(spec.column).cast("double")
    if spec.kind == LAG:
        exact = order.rangeBetween(-spec.window, -spec.window)
        rows, derived = F.count(_ROW).over(exact), F.max(value).over(exact)
    else:
        frame = order.rangeBetween(-spec.window, -1)
        rows, derived = F.count(_ROW).over(frame), AGGREGATES[spec.kind](value).over(frame)
    if spec.kind == "sum":
        return F.coalesce(derived, F.lit(0.0)).alias(spec.name)
    needed = 2 if spec.kind == "std" else 1
    return F.when(rows < needed, F.lit(0.0)).otherwise(derived).alias(spec.name)


def _derive(rows: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    placed = rows.withColumn(_DAY, day_number())
    position = F.col(_DAY)
    cut = into_blocks(placed, position, reach=max_window(specs))
    order = block_window(_DAY)
    derived = cut.select("*", *[asof_column(s, order) for s in specs])
    return derived.filter(owned(position)).drop(BLOCK, _DAY)


def asof_features(series: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """Append one column per spec to every row of the series."""
    return _derive(series.withColumn(_ROW, F.lit(1)), specs).drop(_ROW)


def reachable(history: DataFrame, targets: DataFrame, reach: int) -> DataFrame:
    """History rows of the `reach` days before any target of their station, each once."""
    if reach < 1:
        return history.filter(F.lit(False))
    return band_join(history, targets, F.col(DATE), F.col(DATE), -reach, -1, "left_semi")


def features_at(
    targets: DataFrame, history: DataFrame, specs: Sequence[Spec], calendar: Sequence[str] = ()
) -> DataFrame:
    """Feature rows for arbitrary (station, date) targets from a station history.

    Of the history only the days that some target looks back to are kept. Targets join them as
    marker rows carrying no values, so one windowed pass over these gives all features.
    `targets` holds distinct (station, date) pairs.
    """
    columns = base_columns(specs)
    history = reachable(history, targets, max_window(specs))
    asked = F.lit(None).cast("int").alias(_ROW)
    markers = targets.select(
        KEY, DATE, *[F.lit(None).cast("double").alias(c) for c in columns], asked
    )
    known = history.select(
        KEY, DATE, *[F.col(c).cast("double").alias(c) for c in columns], F.lit(1).alias(_ROW)
    )
    derived = _derive(known.unionByName(markers), specs).filter(F.col(_ROW).isNull())
    names = [s.name for s in specs]
    return derived.select(KEY, DATE, *names, *calendar_columns(calendar, F.col(DATE)))
