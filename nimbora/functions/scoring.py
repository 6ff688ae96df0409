"""Column expressions for forecast values and their errors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_negative(value: Column) -> Column:
    """Clip below at zero."""
    return F.greatest(value, F.lit(0.0))


def severity(mm: Column) -> Column:
    """Level 0..4 of a rain amount; a missing amount falls into the top level."""
    return (
        F.when(mm < 2, 0)
        .when(mm <= 5, 1)
        .when(mm <= 10, 2)
        .when(mm < 50, 3)
        .otherwise(4)
        .cast("int")
    )


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def missed_rain(actual: Column, predicted: Column) -> Column:
    return (actual >= 2) & (predicted < 2)


def false_alarm(actual: Column, predicted: Column) -> Column:
    return (actual <= 2) & (predicted > 2)


def rain_error(actual: Column, predicted: Column) -> Column:
    """Aggregate: mean weighted error, scaled up by the share of penalised days.

    A missed rain day counts five times and a false alarm four times; the error of a
    day with at least 4 mm on both sides is halved.
    """
    missed, alarm = missed_rain(actual, predicted), false_alarm(actual, predicted)
    weight = F.when(missed, F.lit(5.0)).when(alarm, F.lit(4.0)).otherwise(F.lit(1.0))
    both_wet = (actual >= 4) & (predicted >= 4)
    damping = F.when(both_wet, F.lit(0.5)).otherwise(F.lit(1.0))
    penalised = F.when(missed | alarm, F.lit(1.0)).otherwise(F.lit(0.0))
    weighted = absolute_error(actual, predicted) * damping * weight
    return F.avg(weighted) * (F.lit(1.0) + F.avg(penalised))


def mean_absolute_error(actual: Column, predicted: Column) -> Column:
    """Aggregate: mean absolute error."""
    return F.avg(absolute_error(actual, predicted))
