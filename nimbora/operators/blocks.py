"""Windows over long station series without putting a whole station in one task.

A station series is cut along its position axis (row number or day number) into
fixed-size blocks. The last `reach` positions of a block are copied into the block(s)
that follow, so any frame looking back at most `reach` positions finds the same rows
it would find in the whole series. Groups are therefore bounded by `size + reach` rows
however long one station's history is, and one station alone still uses many tasks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.constants import DATE, KEY

ROW_INDEX = "row_index"
BLOCK = "_block"
YEAR = "_year"
BLOCK_ROWS = 1461  # about four years of days


def year_key() -> Column:
    """Year of the day, never NULL.

    A nullable join key would add a filter to one side of the self-join only, and the two
    sides could then no longer share one exchange of the records below.
    """
    return F.coalesce(F.year(DATE), F.lit(0))


def with_row_index(series: DataFrame) -> DataFrame:
    """Add `row_index`: 1-based position of each day in its station's series, by date.

    Days are numbered inside (station, year) groups, at most 366 rows each, and shifted
    by the row counts of the station's earlier years.
    """
    yearly = series.withColumn(YEAR, year_key())
    counts = yearly.groupBy(KEY, YEAR).agg(F.count("*").alias("_rows"))
    return number_rows(yearly, counts.withColumn("_before", rows_before())).drop(
        "_rows", "_before", YEAR
    )


def rows_before() -> Column:
    """Rows of a station's years before this one, over (station, year) row counts."""
    earlier = Window.partitionBy(KEY).orderBy(YEAR).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return F.coalesce(F.sum("_rows").over(earlier), F.lit(0))


def number_rows(yearly: DataFrame, years: DataFrame) -> DataFrame:
    """Join per-(station, year) facts with `_before` and turn it into `row_index`."""
    in_year = F.row_number().over(Window.partitionBy(KEY, YEAR).orderBy(DATE))
    return with_facts(yearly, years).withColumn(
        ROW_INDEX, (F.col("_before") + in_year).cast("int")
    )


def with_facts(yearly: DataFrame, years: DataFrame) -> DataFrame:
    """Attach one fact row to the at most 366 rows of its (station, year).

    A shuffled hash join: it leaves the rows partitioned as the numbering window needs
    them, and keeps small runs from broadcasting the series onto the few fact partitions.
    """
    return yearly.join(years.hint("shuffle_hash"), [KEY, YEAR])


def day_number() -> Column:
    return F.unix_date(DATE)


def into_blocks(series: DataFrame, position: Column, reach: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Add `_block`, repeating a row in each later block whose frames can reach back to it."""
    first = F.floor(position / size)
    last = F.floor((position + reach) / size)
    return series.withColumn(BLOCK, F.explode(F.sequence(first, last)))


def owned(position: Column, size: int = BLOCK_ROWS) -> Column:
    """True for rows in the block they belong to, False for copies."""
    return F.col(BLOCK) == F.floor(position / size)


def block_window(*order: Column | str) -> Window:
    return Window.partitionBy(KEY, BLOCK).orderBy(*order)
