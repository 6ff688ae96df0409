"""Text readings to numbers: decimal commas, rain codes, wind sectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from nimbora.constants import RAIN_CODES, SECTOR_DEGREES, WIND_SENTINELS

# ',' becomes '.', the group mark '.' goes, and letters that would make text such as
# '1f' or 'inf' a valid Java double are spoiled.
_FROM, _TO = ",dDfF.", ".xxxx"


def field_text(name: str) -> Column:
    """Text of a raw field: NULL when the key was absent, '' when it was an explicit JSON null."""
    explicit_null = F.when(F.array_contains("null_keys", name), F.lit(""))
    return F.coalesce(F.col(name), explicit_null)


def decimal_comma(text: Column) -> Column:
    """Number written with '.' as group mark and ',' as decimal mark.

    Blank text and '0' are zero. Absent text stays NULL, and so does text that is no
    number; the text 'NaN' gives NaN.
    """
    number = F.translate(text, _FROM, _TO).try_cast("double")
    return F.when(text == "", F.lit(0.0)).otherwise(number)


def rain_amount(text: Column) -> Column:
    """Like `decimal_comma`, with the exact, case-sensitive rain codes first."""
    value = decimal_comma(text)
    for code, amount in RAIN_CODES.items():
        value = F.when(text == code, F.lit(amount)).otherwise(value)
    return value


def known(number: Column) -> Column:
    """NaN counts as missing."""
    return F.nanvl(number, F.lit(None).cast("double"))


def wind_sector(text: Column) -> Column:
    """Eight 45-degree sectors from tens of degrees; sentinels and non-numbers are NULL.

    360 degrees, and anything else outside [0, 360), is sector 0.
    """
    # A cast would take the suffixes of number literals, as in 12d, for part of the number.
    tens = F.when(~text.rlike(r"[dDfF]\s*$"), text.try_cast("double"))
    inside = (tens >= 0) & (tens < 36)
    return (
        F.when(tens.isin(*WIND_SENTINELS) | F.isnan(tens), F.lit(None).cast("double"))
        .when(inside, F.floor(tens * 10 / SECTOR_DEGREES).cast("double"))
        .when(tens.isNotNull(), F.lit(0.0))
    )


def day(text: Column) -> Column:
    """ISO `yyyy-MM-dd` text to a date, NULL for anything else."""
    return F.try_to_date(text, "yyyy-MM-dd")
