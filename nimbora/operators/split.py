"""Cutoffs, train/test splits and the slices around a cutoff."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.constants import DATE, KEY


def train_test_split(
    rows: DataFrame, min_date: date, max_date: date, horizon: int
) -> tuple[DataFrame, DataFrame]:
    """Rows of [min_date, max_date], and of (max_date, max_date + horizon]."""
    day, last = F.col(DATE), F.lit(max_date).cast("date")
    train = rows.filter((day >= F.lit(min_date).cast("date")) & (day <= last))
    test = rows.filter((day > last) & (day <= F.date_add(last, horizon)))
    return train, test


def resolve_cutoffs(rows: DataFrame, prediction_date: date | None = None) -> DataFrame:
    """(station, cutoff): the day before the requested first forecast day, else the last day."""
    requested = F.date_sub(F.lit(prediction_date).cast("date"), 1)
    return rows.groupBy(KEY).agg(F.coalesce(requested, F.max(DATE)).alias("cutoff"))


def days_around(cutoffs: DataFrame, before: int, after: int) -> DataFrame:
    """Spread each cutoff to the days [cutoff - before, cutoff + after], as `offset`, `date`.

    Turns range conditions around a cutoff into an equi-join on the day.
    """
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")
    return cutoffs.select("*", offsets).withColumn(DATE, F.date_add("cutoff", F.col("offset")))


def join_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows on the given days, of the given station if the days name one.

    Days that name no station come from a grid of cutoffs. Its size is configuration
    (folds x days per fold, some 80,000 rows for 75 years), so it is broadcast and the
    series stays where it is.
    """
    if KEY in days.columns:
        return rows.join(days, [KEY, DATE])
    return rows.join(F.broadcast(days), DATE)


def context_slice(rows: DataFrame, cutoffs: DataFrame, horizon: int, days: int = 30) -> DataFrame:
    """Training rows shown beside a forecast: `days` back from each cutoff, cutoff included.

    The slice ends before the last forecast day, which only matters for a horizon of 0.
    """
    return join_days(rows, days_around(cutoffs, days, min(0, horizon - 1))).drop("offset")


def forecast_days(cutoffs: DataFrame, horizon: int) -> DataFrame:
    """The days each cutoff's forecast covers, as `offset` = step and `date`."""
    return days_around(cutoffs, -1, horizon)


def chart_days(rows: DataFrame, cutoffs: DataFrame, horizon: int) -> DataFrame:
    """Distinct (station, cutoff, date) of context and forecast days together."""
    context = context_slice(rows, cutoffs, horizon).select(KEY, "cutoff", DATE)
    if KEY in cutoffs.columns:
        ahead = forecast_days(cutoffs, horizon).select(KEY, "cutoff", DATE)
    else:
        shown = context.select(KEY, "cutoff").distinct()
        ahead = forecast_days(shown, horizon).select(KEY, "cutoff", DATE)
    return context.union(ahead).distinct()
