"""Row-based features: frames count rows and include the current one."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.constants import DATE, KEY, TARGET
from nimbora.functions.calendar import calendar_columns
from nimbora.operators.blocks import (
    BLOCK,
    ROW_INDEX,
    block_window,
    into_blocks,
    owned,
    with_row_index,
)
from nimbora.operators.specs import LAG, FeatureConfig, Spec, max_window

AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
}


def bulk_column(spec: Spec, order: Window, leak_free: bool = False) -> Column:
    """Window expression of one spec; whatever the frame cannot give is 0.

    The rolling frame ends at the current row. `leak_free` ends it one row earlier.
    """
    value = F.col(spec.column).cast("double")
    if spec.kind == LAG:
        derived = F.lag(value, spec.window).over(order)
    else:
        shift = 1 if leak_free else 0
        frame = order.rowsBetween(-(spec.window - 1) - shift, -shift)
        derived = AGGREGATES[spec.kind](value).over(frame)
    return F.coalesce(derived, F.lit(0.0)).alias(spec.name)


def indexed(series: DataFrame) -> DataFrame:
    return series if ROW_INDEX in series.columns else with_row_index(series)


def bulk_features(series: DataFrame, specs: Sequence[Spec], leak_free: bool = False) -> DataFrame:
    """Append one column per spec. All share one exchange and one sort."""
    position = F.col(ROW_INDEX) - 1
    rows = indexed(series)
    cut = into_blocks(rows, position, reach=max_window(specs))
    order = block_window(ROW_INDEX)
    derived = cut.select("*", *[bulk_column(s, order, leak_free) for s in specs])
    return derived.filter(owned(position)).drop(BLOCK)


def feature_table(
    series: DataFrame,
    config: FeatureConfig,
    warmup: int | None = None,
    leak_free: bool = False,
) -> DataFrame:
    """Clean series + calendar + features, without each station's first `warmup` rows.

    `warmup` defaults to the largest window. A station with no more rows than that
    contributes none; rows with any missing value are dropped.
    """
    skipped = config.warmup if warmup is None else warmup
    rows = bulk_features(series, config.specs, leak_free)
    dated = rows.select("*", *calendar_columns(config.calendar, F.col(DATE)))
    return dated.filter(F.col(ROW_INDEX) > skipped).dropna()


def short_stations(series: DataFrame, warmup: int) -> DataFrame:
    """Stations that have too few rows to yield any feature row."""
    return (
        series.groupBy(KEY)
        .agg(F.count("*").alias("rows"))
        .filter(F.col("rows") <= warmup)
    )


def rolling_week(series: DataFrame) -> DataFrame:
    """(station, date, 7-row precipitation sum), no warm-up drop."""
    week = Spec(TARGET, "sum", 7)
    return bulk_features(series.select(KEY, DATE, TARGET, *_index_of(series)), [week]).select(
        KEY, DATE, F.col(week.name).alias("week_sum")
    )


def _index_of(series: DataFrame) -> list[str]:
    return [ROW_INDEX] if ROW_INDEX in series.columns else []
