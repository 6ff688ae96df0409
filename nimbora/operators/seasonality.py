"""Seasonality profiles: mean 7-row precipitation sum by day of year."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.constants import DATE, KEY
from nimbora.operators.bulk import rolling_week


def seasonality(series: DataFrame) -> DataFrame:
    """(station, day_of_year, week_sum): mean over all years of a clean series."""
    week = rolling_week(series).withColumn("day_of_year", F.dayofyear(DATE))
    return week.groupBy(KEY, "day_of_year").agg(F.avg("week_sum").alias("week_sum"))
