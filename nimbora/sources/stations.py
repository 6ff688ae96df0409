"""Known stations and where their shards live."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.constants import KEY, STATIONS

_SCHEMA = "city string, idema string, folder string, prefix string, first int, past int"


def stations(spark: SparkSession) -> DataFrame:
    """(city, idema) of the known stations: five fixed rows."""
    return spark.createDataFrame(STATIONS, _SCHEMA).select("city", KEY)


def station_shards(spark: SparkSession, root: str = "./data") -> DataFrame:
    """(city, idema, shard, path) of every known shard file."""
    known = spark.createDataFrame(STATIONS, _SCHEMA)
    numbered = known.select(
        "*", F.explode(F.sequence(F.col("first"), F.col("past") - 1)).alias("shard")
    )
    path = F.format_string("%s/%s/%s_%d.json", F.lit(root), "folder", "prefix", "shard")
    return numbered.select("city", KEY, "shard", path.alias("path"))


def shard_glob(city: str, root: str = "./data") -> str:
    """Glob of all shards of one known city, for `read_shards`."""
    for name, _, folder, prefix, *_ in STATIONS:
        if name == city:
            return f"{root}/{folder}/{prefix}_*.json"
    raise ValueError(f"unknown city: {city}")


def with_city(series: DataFrame) -> DataFrame:
    """Add the city of a known station; five dimension rows are broadcast."""
    return series.join(F.broadcast(stations(series.sparkSession)), KEY)
