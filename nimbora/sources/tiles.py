"""Backfill requests cut into tiles no longer than a given number of months."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.constants import KEY


def backfill_tiles(requests: DataFrame, max_months: int = 6) -> DataFrame:
    """(station, start, end) date requests to (station, tile, start, end).

    A tile runs to `max_months` after its start, clamped to the month end, and the next
    starts a day later, so clamping carries on. A remainder of one single day, like a
    request with start = end, yields no tile.
    """
    # A tile and the day after it always cover more than `max_months` months.
    most = F.floor(F.months_between("end", "start") / max_months).cast("int") + 1
    starts = F.aggregate(
        F.sequence(F.lit(1), most),
        F.array("start"),
        lambda tiles, _: F.concat(
            tiles, F.array(F.date_add(F.add_months(F.element_at(tiles, -1), max_months), 1))
        ),
    )
    # A recursive query would say the same but is limited in depth and total rows.
    tiles = requests.filter(F.col("start") < F.col("end")).select(
        KEY, F.col("end").alias("_last"), F.posexplode(starts).alias("_pos", "start")
    )
    tile_end = F.least(F.add_months("start", max_months), F.col("_last"))
    return tiles.filter(F.col("start") < F.col("_last")).select(
        KEY, (F.col("_pos") + 1).alias("tile"), "start", tile_end.alias("end")
    )
