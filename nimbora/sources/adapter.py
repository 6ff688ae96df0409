"""Driver tables as raw station records.

Two views of the same kind of record: orders placed per customer region (few, dense
stations with several records a day) and lines shipped per supplier (a station network
that grows with the data). All expressions are plain SQL both engines understand, so
the oracle texts reuse them; NULL stands for an absent key and '' for a blank value.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.constants import BASE_COLUMNS, DAY, KEY, METRIC_FIELDS
from nimbora.operators.clean import clean_daily, raw_fields
from nimbora.operators.upsert import latest_records

# Steps from a money amount in cents `c` to the readings of one record.
DERIVED = {
    "a": "cast(floor(c / 7) as bigint)",
    "b": "cast(floor(c / 13) as bigint)",
    "g": "cast(floor(c / 17) as bigint)",
    "t": "cast(floor(c / 13) as bigint) % 400 - 50",
}


def _tenths(value: str) -> str:
    """Signed integer tenths as decimal-comma text."""
    return (
        f"concat(case when {value} < 0 then '-' else '' end, "
        f"cast(cast(floor(abs({value}) / 10) as bigint) as string), ',', "
        f"cast(abs({value}) % 10 as string))"
    )


FIELDS = {
    "prec": (
        "case c % 10 when 0 then 'Ip' when 1 then 'Acum' when 2 then null when 3 then '' "
        "when 4 then '0,0' when 5 then '0' else concat("
        "cast(cast(floor((c % 600) / 10) as bigint) as string), ',', "
        "cast(c % 10 as string)) end"
    ),
    "tmed": f"case when c % 13 = 0 then null else {_tenths('t')} end",
    "tmin": f"case when c % 13 = 1 then null else {_tenths('(t - 40 - a % 20)')} end",
    "tmax": f"case when c % 13 = 2 then null else {_tenths('(t + 40 + g % 20)')} end",
    "velmedia": "case when c % 5 = 0 then null else concat("
    "cast(a % 12 as string), ',', cast(g % 10 as string)) end",
    "racha": "case when c % 5 = 1 then null else concat("
    "cast(b % 30 as string), ',', cast(a % 10 as string)) end",
    "presMax": "concat('1.0', lpad(cast(g % 40 as string), 2, '0'), ',', cast(b % 10 as string))",
    "presMin": "concat('1.0', lpad(cast(a % 20 as string), 2, '0'), ',', cast(g % 10 as string))",
    "hrMedia": "case when c % 11 = 0 then null else cast(40 + a % 60 as string) end",
    "sol": "case when c % 3 = 0 then null else concat("
    "cast(b % 14 as string), ',', cast(a % 10 as string)) end",
    "dir": "case when c % 19 = 0 then null when c % 23 = 0 then '99' when c % 29 = 0 "
    "then '88' else cast(g % 37 as string) end",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iso_day(column: str) -> Column:
    return F.col(column).cast("date").cast("string").alias(DAY)


def _as_records(amounts: DataFrame) -> DataFrame:
    """(arrival, idema, fecha, c) to the stored record layout."""
    stepped = amounts.select("*", *[F.expr(e).alias(n) for n, e in DERIVED.items()])
    return stepped.select(
        KEY,
        DAY,
        *[F.expr(FIELDS[f]).alias(f) for f in METRIC_FIELDS],
        F.array().cast("array<string>").alias("null_keys"),
        "arrival",
    )


def region_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order; station = region of the customer, day = order date."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return _as_records(
        placed.select(
            F.col("o_orderkey").alias("arrival"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias(KEY),
            _iso_day("o_orderdate"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"),
        )
    )


def supplier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order line; station = supplier, day = ship date."""
    lines = table(spark, sf_dir, "lineitem")
    return _as_records(
        lines.select(
            # Lines may repeat (order, number); the price keeps arrival unique in practice.
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias(
                "arrival"
            ),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias(KEY),
            _iso_day("l_shipdate"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"),
        )
    )


def daily_series(records: DataFrame, columns: Sequence[str] = BASE_COLUMNS) -> DataFrame:
    """Upserted and cleaned series of the given columns, with `row_index`."""
    latest = latest_records(records, columns=raw_fields(columns))
    return clean_daily(latest, row_index=True, columns=columns)
