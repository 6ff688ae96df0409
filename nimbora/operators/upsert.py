"""Keyed upsert: the last record to arrive for a (station, day) wins."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.constants import DAY, KEY
from nimbora.functions.packing import pack_texts, split_texts, unpack_texts

_TEXTS = "_texts"


def keyed(records: DataFrame) -> DataFrame:
    """Records with a usable key; blank station or day is skipped."""
    return records.filter((F.col(KEY) != "") & (F.col(DAY) != ""))


def latest_records(
    records: DataFrame, arrival: str = "arrival", columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per (station, day): the one with the greatest `arrival`.

    `arrival` may be any orderable column, a struct included, and must be unique within a
    key. `max_by` keeps one candidate per key in each map task, so a key repeated in a
    third of all rows still shuffles one row per task. Texts travel packed into one.
    """
    kept = list(columns or [c for c in records.columns if c not in (KEY, DAY, arrival)])
    kinds = dict(records.dtypes)
    texts = [c for c in kept if kinds[c] == "string"]
    if len(texts) < 2:
        winner = F.max_by(F.struct(*kept), arrival).alias("winner")
        return keyed(records).groupBy(KEY, DAY).agg(winner).select(KEY, DAY, "winner.*")
    return unpacked(latest_packed(records.select(KEY, DAY, arrival, *kept), texts, arrival), texts).select(KEY, DAY, *kept)


def latest_packed(records: DataFrame, texts: Sequence[str], arrival: str = "arrival") -> DataFrame:
    """`latest_records` of all columns, these texts still packed: for rows that travel on."""
    return _last(_packed(records, texts, arrival), arrival, (KEY, DAY))


def latest_placed(
    records: DataFrame, texts: Sequence[str], place: Sequence[str], crowded: Column | None, arrival: str = "arrival"
) -> DataFrame:
    """`latest_packed` of rows that are to lie in order of (*place, station, day), where `place` follows
    from the key. Rows travel once: dealt by range of that order, those of a key meet where they stay.
    Rows for which `crowded` holds, all or none of a key, are first thinned to one a key, which starts
    in each map task: a key that has very many rows would meet in one task without that."""
    order = [*place, KEY, DAY]
    rows = _packed(records, texts, arrival)
    if crowded is not None:
        many = rows.filter(crowded)
        thinned = _last(many.withColumn("_at", F.col(arrival)), "_at", order).select(rows.columns)
        rows = rows.filter(~crowded).unionByName(thinned)
    return _last(rows.repartitionByRange(*order), arrival, order).sortWithinPartitions(*order)


def _packed(records: DataFrame, texts: Sequence[str], arrival: str) -> DataFrame:
    others = [c for c in records.columns if c not in (KEY, DAY, arrival, *texts)]
    return keyed(records).select(KEY, DAY, arrival, pack_texts(texts).alias(_TEXTS), *others)


def _last(rows: DataFrame, arrival: str, key: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest `arrival`, without that."""
    winner = F.max_by(F.struct(*[c for c in rows.columns if c not in (arrival, *key)]), arrival)
    return rows.groupBy(*key).agg(winner.alias("winner")).select(*key, "winner.*")


def unpacked(records: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Records with the packed texts as columns again."""
    others = [c for c in records.columns if c != _TEXTS]
    parts = records.select(*others, split_texts(F.col(_TEXTS)).alias(_TEXTS))
    return parts.select(*others, *unpack_texts(F.col(_TEXTS), texts))


def stored_and_fresh(existing: DataFrame, incoming: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Stored rows (without `arrival`) and incoming ones together, with an `arrival` by which stored
    rows always lose."""
    at = incoming.schema[arrival].dataType
    order = F.struct(F.lit(1).alias("fresh"), F.col(arrival).alias("at"))
    stored_order = F.struct(F.lit(0).alias("fresh"), F.lit(None).cast(at).alias("at"))
    return existing.withColumn(arrival, stored_order).unionByName(incoming.withColumn(arrival, order))


def upsert_counts(records: DataFrame, source: str = "path") -> DataFrame:
    """Rows attempted per source file, duplicates included, blank keys not."""
    return keyed(records).groupBy(source).agg(F.count("*").alias("records"))
