"""The stored record layout, and JSON objects to and from it.

A record is `idema, fecha`, the eleven metric texts, `null_keys` (metric keys whose JSON
value was an explicit null, as opposed to absent) and `rest`, a map of every other key.
Typed columns rather than one map keep scans prunable; `rest` keeps the payload whole.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.constants import DAY, DAY_FIELD, KEY, METRIC_FIELDS, STATION_FIELD

RECORD_COLUMNS = (KEY, DAY, *METRIC_FIELDS, "null_keys", "rest")

_WHITESPACE = " \t\n\r\x0b\x0c"


def key_text(fields: Column, name: str) -> Column:
    """Trimmed key; absent gives '', an explicit null gives the text 'None'."""
    present = F.when(F.map_contains_key(fields, name), F.lit("None"))
    value = F.coalesce(F.try_element_at(fields, F.lit(name)), present, F.lit(""))
    return F.btrim(value, F.lit(_WHITESPACE))


def from_fields(objects: DataFrame, fields: str = "fields") -> DataFrame:
    """Spread a `map<string,string>` column into the record layout, keeping other columns."""
    cells = F.col(fields)
    metrics = F.array(*[F.lit(f) for f in METRIC_FIELDS])
    nulls = F.filter(
        metrics,
        lambda k: F.map_contains_key(cells, k) & F.try_element_at(cells, k).isNull(),
    )
    rest = F.map_filter(cells, lambda k, _: ~k.isin(*METRIC_FIELDS))
    others = [c for c in objects.columns if c != fields]
    return objects.select(
        *others,
        key_text(cells, STATION_FIELD).alias(KEY),
        key_text(cells, DAY_FIELD).alias(DAY),
        *[F.try_element_at(cells, F.lit(f)).alias(f) for f in METRIC_FIELDS],
        nulls.alias("null_keys"),
        rest.alias("rest"),
    )


def to_json_text(records: DataFrame) -> Column:
    """JSON object text of a record, explicit nulls and unknown keys included."""
    keys = F.create_map(
        F.lit(STATION_FIELD), F.col(KEY), F.lit(DAY_FIELD), F.col(DAY)
    )
    metrics = F.create_map(*[x for f in METRIC_FIELDS for x in (F.lit(f), F.col(f))])
    shown = F.map_filter(metrics, lambda k, v: v.isNotNull() | F.array_contains("null_keys", k))
    layers = [shown]
    if "rest" in records.columns:
        unkeyed = F.map_filter("rest", lambda k, _: ~k.isin(STATION_FIELD, DAY_FIELD))
        rest_keys = F.map_filter("rest", lambda k, _: k.isin(STATION_FIELD, DAY_FIELD))
        missing = F.map_filter(keys, lambda k, _: ~F.map_contains_key("rest", k))
        layers = [rest_keys, missing, shown, unkeyed]
    else:
        layers = [keys, shown]
    return F.to_json(F.map_concat(*layers), {"ignoreNullFields": "false"})
