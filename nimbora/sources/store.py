"""The record store: Parquet, one row per (station, day), in versions.

  data/snapshot=.../bucket=.../year_text=.../   the records, by station hash bucket and year
  _zones/<snapshot>/                            a row for each station and folder: first, last day, rows
  _versions/v<number>                           a small file that names a version's zones

An upsert writes the (bucket, year) folders it touches anew, below a snapshot of its own, then the
zones of the new version, and last the version file, put in place by one rename. Until then
readers see the version before it, whole; a reader keeps the files it has started with. Folders
that an upsert doesn't touch are shared by the versions.

The zones say which folders hold a station's days, so range scans and trailing windows name their
folders without listing or scanning the data.
"""

import re
import uuid
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbora.constants import DAY, KEY, METRIC_FIELDS
from nimbora.operators.bands import band_join
from nimbora.operators.upsert import keyed, latest_placed, stored_and_fresh, unpacked
from nimbora.sources.records import RECORD_COLUMNS

BUCKET, YEAR, SNAPSHOT = "bucket", "year_text", "snapshot"
LAYOUT = (BUCKET, YEAR)
#: The keys of a folder are dealt to so many cells. A cell with more rows than both of these, a number and
#: a share of its folder, may hold a key that alone has so many.
CELL, CELLS = "cell", 256
CROWD_ROWS, CROWD_SHARE = 100_000, 32
TEXTS = "map<string,string>"
STORED_SCHEMA = (
    f"{KEY} string, {DAY} string, {', '.join(f'{m} string' for m in METRIC_FIELDS)}, null_keys array<string>, "
    f"rest {TEXTS}, {SNAPSHOT} string, {BUCKET} int, {YEAR} string"
)
ZONE_SCHEMA = f"{KEY} string, {BUCKET} int, {YEAR} string, first_day string, last_day string, rows long, folder string"


def _bucket(station: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(station), F.lit(buckets)).cast("int")


def _year(day: Column) -> Column:
    """First four characters of the day text; days are compared as text."""
    return F.substring(day, 1, 4)


@dataclass(frozen=True)
class Version:
    """A committed state of a store."""

    number: int
    buckets: int
    zones: str


class RecordStore:
    """A folder of upserted records.

    The number of buckets is that of the first upsert: it is kept with the data, and `buckets`
    only counts for a new store.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets

    @property
    def buckets(self) -> int:
        current = self.current()
        return current.buckets if current else self._buckets

    def _file(self, path: str):
        """Hadoop file system and path, of whatever store the path names."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, folder: str) -> list[str]:
        files, target = self._file(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []

    def versions(self) -> list[int]:
        """Numbers of the committed versions, ascending."""
        return sorted(int(n[1:]) for n in self._names("_versions") if re.fullmatch(r"v\d{10}", n))

    def version(self, number: int) -> Version:
        files, target = self._file(f"{self.path}/_versions/v{number:010d}")
        stream = files.open(target)
        try:
            return Version(number, stream.readInt(), stream.readUTF())
        finally:
            stream.close()

    def current(self) -> Version | None:
        numbers = self.versions()
        return self.version(numbers[-1]) if numbers else None

    def exists(self) -> bool:
        return bool(self.versions())

    def zones(self, version: Version | None = None) -> DataFrame:
        """A row for each station and folder: idema, bucket, year_text, first_day, last_day, rows,
        folder. Without a version, of the current one."""
        version = version or self.current()
        if version is None:
            raise FileNotFoundError(f"no record store at {self.path}; import shards first")
        return self.spark.read.schema(ZONE_SCHEMA).parquet(f"{self.path}/_zones/{version.zones}")

    def read(self, version: int | None = None) -> DataFrame:
        """All records of the current version, or of a numbered one."""
        pinned = self.current() if version is None else self.version(version)
        return self._read(self.zones(pinned)).drop(SNAPSHOT, *LAYOUT)

    def upsert(self, records: DataFrame, arrival: str = "arrival") -> int:
        """Merge records in; the last arrival wins. Returns the rows attempted.

        `records` is read three times, to name the folders, to find the ranges of days and stations that
        tasks take, and to merge; give a stable source. Records travel once. One upsert at a time: of two that start from the same version the second to end raises, and stores
        nothing.
        """
        incoming = keyed(_complete(records)).select(*RECORD_COLUMNS, arrival)
        current = self.current()
        buckets = current.buckets if current else self._buckets
        touched = _folders(_placed(incoming, buckets))
        if not touched:
            return 0
        number = current.number + 1 if current else 1
        snapshot = f"{number:010d}-{uuid.uuid4().hex[:12]}"
        folders = self.spark.createDataFrame([(r[BUCKET], r[YEAR]) for r in touched], f"{BUCKET} int, {YEAR} string")
        if current:
            old = self.zones(current)
            kept = old.join(F.broadcast(folders), [*LAYOUT], "left_anti")
            stored = self._read(old.join(F.broadcast(folders), [*LAYOUT], "left_semi")).drop(SNAPSHOT, *LAYOUT)
            incoming = stored_and_fresh(stored, incoming, arrival)
        else:
            kept = None
        placed = _placed(incoming, buckets)
        self._write(latest_placed(placed, METRIC_FIELDS, LAYOUT, _crowded(touched), arrival), snapshot)
        zones = self._zones_of(snapshot)
        if kept is not None:
            zones = zones.unionByName(kept.select(zones.columns))
        zones.write.parquet(f"{self.path}/_zones/{snapshot}")
        self._commit(Version(number, buckets, snapshot))
        return sum(r["count"] for r in touched)

    def _write(self, records: DataFrame, snapshot: str) -> None:
        """Write records in order, whose texts are packed. One folder may be the work of many tasks."""
        unpacked(records, METRIC_FIELDS).write.partitionBy(*LAYOUT).parquet(f"{self.path}/data/{SNAPSHOT}={snapshot}")

    def _zones_of(self, snapshot: str) -> DataFrame:
        folder = F.regexp_extract("_metadata.file_path", rf"/data/({SNAPSHOT}=.*)/[^/]*$", 1).alias("folder")
        schema = T._parse_datatype_string(STORED_SCHEMA)
        written = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(
            f"{self.path}/data/{SNAPSHOT}={snapshot}"
        )
        rows = written.select(KEY, DAY, *LAYOUT, folder)
        return rows.groupBy(KEY, *LAYOUT, "folder").agg(
            F.min(DAY).alias("first_day"), F.max(DAY).alias("last_day"), F.count("*").alias("rows")
        )

    def _commit(self, version: Version) -> None:
        """The step that makes a version: a rename onto a name that must be free."""
        target_name = f"{self.path}/_versions/v{version.number:010d}"
        files, target = self._file(target_name)
        _, aside = self._file(f"{self.path}/_versions/.{version.zones}")
        stream = files.create(aside)
        try:
            stream.writeInt(version.buckets)
            stream.writeUTF(version.zones)
        finally:
            stream.close()
        if files.exists(target) or not files.rename(aside, target):
            raise RuntimeError(f"another upsert has made version {version.number}; upsert again")

    def drop_old(self, keep: int = 2) -> list[int]:
        """Remove all but the last `keep` versions and the files no kept one names; readers that
        still hold a removed version fail. Returns the removed numbers."""
        numbers = self.versions()
        gone, kept = numbers[:-keep], [self.version(n) for n in numbers[-keep:]]
        if not gone:
            return []
        used = {self._snapshot(r.folder) for v in kept for r in self.zones(v).select("folder").distinct().collect()}
        for n in gone:
            files, target = self._file(f"{self.path}/_versions/v{n:010d}")
            files.delete(target, False)
        for folder, name_of in (("data", lambda n: n.split("=", 1)[-1]), ("_zones", str)):
            held = used if folder == "data" else {v.zones for v in kept}
            for name in self._names(folder):
                # What is newer than the kept versions may be an upsert in progress.
                if name_of(name) not in held and int(name_of(name)[:10]) < kept[0].number:
                    files, target = self._file(f"{self.path}/{folder}/{name}")
                    files.delete(target, True)
        return gone

    @staticmethod
    def _snapshot(folder: str) -> str:
        return folder.split("/", 1)[0].split("=", 1)[1]

    def station_range(
        self, station: str, start: date | None = None, end: date | None = None
    ) -> DataFrame:
        """Records of one station with start <= day <= end, by day; only folders that hold some."""
        current = self.current()
        zones = self.zones(current).filter(F.col(KEY) == station)
        wanted = (F.col(KEY) == station) & (F.col(BUCKET) == _bucket(F.lit(station), current.buckets))
        if start is not None:
            zones = zones.filter(F.col("last_day") >= start.isoformat())
            wanted &= (F.col(DAY) >= start.isoformat()) & (F.col(YEAR) >= f"{start.year:04d}")
        if end is not None:
            zones = zones.filter(F.col("first_day") <= end.isoformat())
            wanted &= (F.col(DAY) <= end.isoformat()) & (F.col(YEAR) <= f"{end.year:04d}")
        return self._read(zones).filter(wanted).drop(SNAPSHOT, *LAYOUT).orderBy(DAY)

    def load_station(
        self,
        station: str,
        start: date | None = None,
        end: date | None = None,
        lookback_days: int | None = None,
    ) -> DataFrame:
        """Range scan; `lookback_days` replaces `start` and counts back from `end`.

        Without `end`, the station's last stored day is used, which the zones hold. n lookback days
        are n + 1 days inclusive. An unknown station gives no rows, a missing store raises.
        """
        zones = self.zones()
        if lookback_days is not None:
            if end is None:
                (row,) = zones.filter(F.col(KEY) == station).agg(F.max("last_day").alias("last")).collect()
                if row.last is None:
                    return self.station_range(station).limit(0)
                end = date.fromisoformat(row.last)
            start = end - timedelta(days=lookback_days)
        return self.station_range(station, start, end)

    def trailing_window(self, lookback_days: int, end: date | None = None) -> DataFrame:
        """`trailing_window` of the stored records. Last days and the folders to read come from the
        zones; folders without a day of any station's window are not read."""
        zones = self.zones()
        last = F.to_date(F.max("last_day")) if end is None else F.lit(end)
        cutoffs = zones.groupBy(KEY).agg(last.alias("cutoff"))
        first = F.date_sub("cutoff", lookback_days).cast("string")
        reached = (F.col("last_day") >= first) & (F.col("first_day") <= F.col("cutoff").cast("string"))
        held = zones.join(cutoffs, KEY).filter(reached)
        records = self._read(held).drop(SNAPSHOT, *LAYOUT)
        return inference_window(records, cutoffs, lookback_days, 0).drop("cutoff")

    def _read(self, zones: DataFrame) -> DataFrame:
        """The records of the folders that these zones name: at most buckets x years."""
        folders = sorted(unquote(r.folder) for r in zones.select("folder").distinct().collect())
        reader = self.spark.read.schema(STORED_SCHEMA)
        if not folders:
            return self.spark.createDataFrame([], STORED_SCHEMA)
        plain = [re.sub(r"([\[\]{}*?,\\])", r"\\\1", f) for f in folders]
        return reader.option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/{f}" for f in plain))


def _placed(records: DataFrame, buckets: int) -> DataFrame:
    return records.withColumn(BUCKET, _bucket(F.col(KEY), buckets)).withColumn(YEAR, _year(F.col(DAY)))


def _cell() -> Column:
    return F.pmod(F.xxhash64(KEY, DAY), F.lit(CELLS)).cast("int")


def _folders(placed: DataFrame) -> list:
    """(bucket, year_text, count, crowded) of each folder: at most buckets x years rows, each with the
    few cells, fewer than CROWD_SHARE, that hold very many of its records."""
    cells = placed.groupBy(*LAYOUT, _cell().alias(CELL)).agg(F.count("*").alias("held"))
    folders = cells.groupBy(*LAYOUT).agg(
        F.sum("held").alias("count"), F.collect_list(F.struct("held", CELL)).alias("cells")
    )
    much = F.greatest(F.lit(CROWD_ROWS), F.col("count") / CROWD_SHARE)
    crowded = F.transform(F.filter("cells", lambda c: c["held"] > much), lambda c: c[CELL])
    return folders.select(*LAYOUT, "count", crowded.alias("crowded")).collect()


def _crowded(folders: list) -> Column | None:
    """Whether a placed record lies in a crowded cell; None where there are none."""
    crowds = [
        (F.col(BUCKET) == f[BUCKET]) & (F.col(YEAR) == f[YEAR]) & _cell().isin(f["crowded"]) for f in folders if f["crowded"]
    ]
    return reduce(or_, crowds) if crowds else None


def _complete(records: DataFrame) -> DataFrame:
    """Fill in the optional parts of the record layout."""
    if "null_keys" not in records.columns:
        records = records.withColumn("null_keys", F.array().cast("array<string>"))
    if "rest" not in records.columns:
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        records = records.withColumn("rest", none)
    return records


def trailing_window(records: DataFrame, lookback_days: int, end: date | None = None) -> DataFrame:
    """Last `lookback_days` + 1 days of every station at once, up to its last day or `end`."""
    last = records.groupBy(KEY).agg(F.to_date(F.max(DAY)).alias("cutoff"))
    if end is not None:
        last = last.select(KEY, F.lit(end).alias("cutoff"))
    return inference_window(records, last, lookback_days, 0).drop("cutoff")


def inference_window(
    records: DataFrame, cutoffs: DataFrame, lookback_days: int, horizon: int
) -> DataFrame:
    """Rows of [cutoff - lookback, cutoff + horizon] for every (station, cutoff).

    Joined by bands of days; a station with very many records does not meet in one task. A day text
    that is not an ISO date is in no window.
    """
    day = F.try_to_date(DAY, "yyyy-MM-dd")
    iso = F.when(day.cast("string") == F.col(DAY), day)
    return band_join(records, cutoffs.select(KEY, "cutoff"), iso, F.col("cutoff"), -lookback_days, horizon)
