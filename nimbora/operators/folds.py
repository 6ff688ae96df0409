"""Expanding-window folds: the cutoff grid and the days each fold needs."""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.constants import KEY, TARGET
from nimbora.functions.arrays import let
from nimbora.operators.blocks import ROW_INDEX
from nimbora.operators.split import days_around, join_days
from nimbora.session import dealt_by

FOLD = "fold_id"


def year_list(spark: SparkSession, years: Iterable[int]) -> DataFrame:
    """Years to evaluate, as a table."""
    return spark.createDataFrame([(int(y),) for y in years], "year int")


def years_of(series: DataFrame) -> DataFrame:
    """Calendar years a series has rows in, as a table."""
    return series.select(F.year("date").alias("year")).distinct()


def fold_grid(
    years: DataFrame,
    horizon: int,
    year_min_day: int | None = None,
    year_max_day: int | None = None,
) -> DataFrame:
    """(fold_id, year, start_day, cutoff): a cutoff every `horizon` days of each year.

    `start_day` runs from 0 to the length of the year, inclusive, and counts from the
    last day of the year before. 0 for either bound means its default.
    """
    year_end = F.make_date("year", F.lit(12), F.lit(31))
    first = F.lit(year_min_day or 0)
    past = F.lit(year_max_day) if year_max_day else F.dayofyear(year_end) + 1
    starts = F.when(past > first, F.sequence(first, past - 1, F.lit(horizon)))
    grid = years.select("year", F.explode(starts).alias("start_day"))
    eve = F.make_date(F.col("year") - 1, F.lit(12), F.lit(31))
    return grid.select(
        (F.col("year") * 1000 + F.col("start_day")).alias(FOLD),
        "year",
        "start_day",
        F.date_add(eve, F.col("start_day")).alias("cutoff"),
    )


def cutoff_grid(spark: SparkSession, cutoffs: Iterable) -> DataFrame:
    """A grid of explicitly listed cutoff dates; the fold id is their rank."""
    rows = [(i, d.year, d) for i, d in enumerate(sorted(set(cutoffs)), start=1)]
    return spark.createDataFrame(rows, f"{FOLD} int, year int, cutoff date")


def fold_windows(
    series: DataFrame, grid: DataFrame, inputs: Sequence[str], lookback: int, horizon: int
) -> DataFrame:
    """One row per (station, fold) with any row near its cutoff.

    `history` lists (offset, row_index, inputs...) of the `lookback` days ending at the
    cutoff, `observed` lists (offset, row_index, actual) of the `horizon` days after it.
    The training rows of a fold are never copied.
    """
    days = days_around(grid.select(FOLD, "cutoff"), lookback - 1, horizon)
    near = join_days(series.select(KEY, "date", ROW_INDEX, *inputs), days)
    past = F.when(
        F.col("offset") <= 0,
        F.struct("offset", ROW_INDEX, *[F.col(c).cast("double").alias(c) for c in inputs]),
    )
    ahead = F.when(
        F.col("offset") > 0,
        F.struct("offset", ROW_INDEX, F.col(TARGET).cast("double").alias("actual")),
    )
    return dealt_by(near, KEY, FOLD).groupBy(KEY, FOLD).agg(
        F.collect_list(past).alias("history"),
        F.sort_array(F.collect_list(ahead)).alias("observed"),
    )


def dense_history(inputs: Sequence[str], lookback: int, warmup: int = 0) -> dict[str, Column]:
    """Per input an array of the last `lookback` days, oldest first, NULL = no row.

    Days among the station's first `warmup` rows are no part of a feature table and so
    are not history either.
    """
    kept = F.filter("history", lambda e: e[ROW_INDEX] > warmup)
    offsets = F.sequence(F.lit(-lookback + 1), F.lit(0))

    def values(column: str) -> Column:
        entries = F.transform(kept, lambda e: F.struct(e["offset"], e[column]))
        return let(
            F.map_from_entries(entries),
            lambda by_offset: F.transform(offsets, lambda k: F.try_element_at(by_offset, k)),
        )

    return {c: values(c) for c in inputs}


def observed_values(warmup: int = 0) -> Column:
    """Actual values in day order; position, not date, pairs them with forecast steps."""
    kept = F.filter("observed", lambda e: e[ROW_INDEX] > warmup)
    return F.transform(kept, lambda e: e["actual"])


def test_rows(rows: DataFrame, grid: DataFrame, horizon: int) -> DataFrame:
    """Rows of (cutoff, cutoff + horizon] of every fold, with `fold_id`, `cutoff`, `offset`."""
    return join_days(rows, days_around(grid.select(FOLD, "cutoff"), -1, horizon))
