"""Raw text records to the clean daily table: parse, impute, rename."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.constants import (
    BASE_COLUMNS,
    CLEAN_NAMES,
    DATE,
    DAY,
    KEY,
    NUMBER_FIELDS,
    WIND_DIRECTION,
    WIND_FIELD,
)
from nimbora.functions.parsing import (
    day,
    decimal_comma,
    field_text,
    known,
    rain_amount,
    wind_sector,
)
from nimbora.operators.blocks import (
    ROW_INDEX,
    YEAR,
    number_rows,
    rows_before,
    with_facts,
    year_key,
)


def raw_fields(columns: Sequence[str] = BASE_COLUMNS) -> list[str]:
    """Raw field of each clean column, plus what tells absent from explicit null."""
    wanted = [f for f, c in CLEAN_NAMES.items() if c in columns]
    if len(wanted) != len(set(columns)):
        raise ValueError(f"unknown clean columns: {sorted(set(columns) - set(BASE_COLUMNS))}")
    return [*wanted, "null_keys"]


def _read_cells(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(station, day text, date, field texts, numbers); NULL number = absent or unreadable.

    Texts are projected first so that each is worked out once per row.
    """
    fields = {f: CLEAN_NAMES[f] for f in raw_fields(columns)[:-1]}
    readers = {WIND_FIELD: wind_sector, "prec": rain_amount}
    texts = records.select(KEY, DAY, *[field_text(f).alias(f) for f in fields])
    numbers = [readers.get(f, decimal_comma)(F.col(f)).alias(c) for f, c in fields.items()]
    return texts.select("*", day(F.col(DAY)).alias(DATE), *numbers)


def _bad_cells(columns: Sequence[str]) -> list[tuple[str, Column]]:
    """(field, condition) of every cell that has text but no value.

    Wind text that is no number is merely missing.
    """
    cells = [
        (f, F.col(f).isNotNull() & F.col(c).isNull())
        for f, c in NUMBER_FIELDS.items()
        if c in columns
    ]
    return [(DAY, F.col(DATE).isNull()), *cells]


def parse_records(
    records: DataFrame, strict: bool = True, columns: Sequence[str] = BASE_COLUMNS
) -> DataFrame:
    """(station, date, numeric columns), missing readings still NULL.

    Strict parsing raises on a reading or day that cannot be read. Otherwise the reading
    becomes missing, the record with an unreadable day is left out, and
    `unreadable_readings` lists both.
    """
    cells = _read_cells(records, columns)
    date = F.col(DATE)
    if strict:
        checks = [condition for _, condition in _bad_cells(columns)]
        where = F.concat(F.lit("unreadable reading: station "), KEY, F.lit(", day "), DAY)
        date = F.when(reduce(or_, checks), F.raise_error(where).cast("date")).otherwise(date)
    else:
        cells = cells.filter(date.isNotNull())
    numbers = [known(F.col(c)).alias(c) for c in columns]
    return cells.select(KEY, date.alias(DATE), *numbers)


def unreadable_readings(records: DataFrame) -> DataFrame:
    """Quarantine list: one row (station, day, field, text) per cell that cannot be read."""
    cells = [
        F.when(bad, F.struct(F.lit(f).alias("field"), F.col(f).alias("text")))
        for f, bad in _bad_cells(BASE_COLUMNS)
    ]
    listed = F.inline(F.array_compact(F.array(*cells)))
    return _read_cells(records, BASE_COLUMNS).select(KEY, DAY, listed)


def station_year_facts(parsed: DataFrame, columns: Sequence[str] = BASE_COLUMNS) -> DataFrame:
    """Per (station, year): earlier row count, and the station-wide mean of every column.

    Readings are summed map-side per (station, year); only those sums meet per station.
    A station with no reading at all for a column gets 0.
    """
    sums = [F.sum(c).alias(f"_sum_{c}") for c in columns]
    seen = [F.count(c).alias(f"_seen_{c}") for c in columns]
    yearly = parsed.groupBy(KEY, YEAR).agg(F.count("*").alias("_rows"), *sums, *seen)
    station = Window.partitionBy(KEY)

    def mean(c: str) -> Column:
        total, n = F.sum(f"_sum_{c}").over(station), F.sum(f"_seen_{c}").over(station)
        return F.coalesce(F.when(n > 0, total / n), F.lit(0.0)).alias(f"_mean_{c}")

    return yearly.select(KEY, YEAR, rows_before().alias("_before"), *[mean(c) for c in columns])


def clean_daily(
    records: DataFrame,
    strict: bool = True,
    row_index: bool = False,
    columns: Sequence[str] = BASE_COLUMNS,
) -> DataFrame:
    """Clean daily table of one record per (station, day).

    Missing readings take the mean of all loaded rows of the station, so the loaded date
    range matters. Wind sectors take the mean sector, truncated. With `row_index` the
    position of each day in its station's series is kept for the row-based features;
    `columns` limits the work to the readings a caller needs.
    """
    parsed = parse_records(records, strict, columns).withColumn(YEAR, year_key())
    facts = station_year_facts(parsed, columns)
    joined = number_rows(parsed, facts) if row_index else with_facts(parsed, facts)
    filled = [
        F.coalesce(F.col(c), F.col(f"_mean_{c}"))
        .cast("int" if c == WIND_DIRECTION else "double")
        .alias(c)
        for c in columns
    ]
    return joined.select(KEY, DATE, *filled, *([ROW_INDEX] if row_index else []))


def station_means(records: DataFrame, strict: bool = True) -> DataFrame:
    """The fill value of every column per station."""
    parsed = parse_records(records, strict)
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in BASE_COLUMNS]
    return parsed.groupBy(KEY).agg(*means)
