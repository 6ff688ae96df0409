import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from nimbora.operators.upsert import latest_records, upsert_counts
from nimbora.sources.shards import (
    discover_shards,
    read_lines,
    read_shards,
    read_shards_tolerant,
    shard_paths,
)
from nimbora.sources.sinks import write_json_lines
from nimbora.sources.stations import shard_glob, station_shards, stations, with_city
from nimbora.sources.store import RecordStore, trailing_window
from nimbora.sources.tiles import backfill_tiles
from nimbora.streaming.ingest import stream_upsert


@pytest.fixture
def shard_dir(tmp_path, make):
    first = [make.raw("2024-01-01", prec="1,0"), make.raw("2024-01-02", prec="2,0", extra="kept"), 5, "x"]
    later = [
        {"indicativo": " 1082 ", "fecha": "2024-01-01", "prec": "9,9", "sol": None},
        {"indicativo": "1082", "fecha": "2024-01-01 ", "prec": "8,8"},
        {"indicativo": "", "fecha": "2024-01-05"},
        {"fecha": "2024-01-06"},
        {"indicativo": None, "fecha": "2024-01-07"},
    ]
    (tmp_path / "city").mkdir()
    (tmp_path / "city" / "shard_9.json").write_text(json.dumps(first))
    (tmp_path / "city" / "shard_10.json").write_text(json.dumps(later))
    (tmp_path / "note.txt").write_text("no shard")
    return tmp_path


def test_shards_are_found_recursively_in_path_order(spark, shard_dir):
    names = [r.path.rsplit("/", 1)[1] for r in shard_paths(spark, str(shard_dir)).collect()]
    assert names == ["shard_10.json", "shard_9.json"]
    assert discover_shards(spark, str(shard_dir)).count() == 2


def test_import_skips_non_objects_and_blank_keys_and_last_file_wins(spark, shard_dir):
    loaded = read_shards(spark, str(shard_dir))
    latest = {(r.idema, r.fecha): r for r in latest_records(loaded).collect()}
    # shard_10 sorts before shard_9, so the later file in path order is shard_9.
    assert latest["1082", "2024-01-01"].prec == "1,0"
    assert latest["1082", "2024-01-02"].rest["extra"] == "kept"
    assert set(latest) == {("1082", "2024-01-01"), ("1082", "2024-01-02"), ("None", "2024-01-07")}
    counts = {r.path.rsplit("/", 1)[1]: r.records for r in upsert_counts(loaded).collect()}
    assert counts == {"shard_9.json": 2, "shard_10.json": 3}


def test_absent_and_null_keys_stay_apart(spark, shard_dir):
    rows = read_shards(spark, str(shard_dir)).filter(F.col("path").contains("shard_10")).collect()
    assert [r.null_keys for r in rows][:2] == [["sol"], []]


def test_a_shard_that_is_no_array_stops_the_import(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"fecha": "2024-01-01"}')
    with pytest.raises(Exception, match="Expected a JSON array"):
        read_shards(spark, str(tmp_path)).collect()


def test_tolerant_load_rejects_files_and_keeps_the_rest(spark, shard_dir):
    (shard_dir / "bad.json").write_text("[{")
    (shard_dir / "object.json").write_text("{}")
    load = read_shards_tolerant(spark, str(shard_dir))
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in load.rejected.collect()}
    assert errors == {"bad.json": "not valid JSON", "object.json": "not a JSON array"}
    assert load.records.count() == 7


def test_json_lines_round_trip(spark, shard_dir, tmp_path):
    latest = latest_records(read_shards(spark, str(shard_dir)))
    write_json_lines(latest, str(tmp_path / "lines"))
    again = latest_records(read_lines(spark, str(tmp_path / "lines")))
    first, second = (sorted(map(str, x.drop("path").collect())) for x in (latest, again))
    assert first == second


def test_upsert_last_write_wins_and_counts_attempts(spark, records, make, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"), buckets=2)
    twice = [*make.daily("2024-01-01", 90), make.raw("2024-01-01", prec="5,0")]
    assert store.upsert(records(twice)) == 91
    assert store.upsert(records([make.raw("2024-01-01", prec="9,9", indicativo=" 1082 ")])) == 1
    assert store.upsert(records([{"fecha": "2024-01-01"}])) == 0
    assert store.read().count() == 90
    (first,) = store.station_range("1082", date(2024, 1, 1), date(2024, 1, 1)).collect()
    assert first.prec == "9,9"


def test_range_and_lookback_are_inclusive(spark, records, make, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"), buckets=2)
    store.upsert(records(make.daily("2024-01-01", 90)))
    days = [r.fecha for r in store.station_range("1082", date(2024, 1, 10), date(2024, 1, 20)).collect()]
    assert (len(days), days[0], days[-1]) == (11, "2024-01-10", "2024-01-20")
    back = store.load_station("1082", start=date(2024, 1, 1), end=date(2024, 3, 1), lookback_days=10)
    days = [r.fecha for r in back.collect()]
    assert (len(days), days[0], days[-1]) == (11, "2024-02-20", "2024-03-01")
    assert store.load_station("1082", lookback_days=10).count() == 11
    assert store.load_station("nowhere", lookback_days=10).count() == 0


def test_missing_store(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        RecordStore(spark, str(tmp_path / "none")).load_station("1082")


def test_range_scan_prunes_folders(spark, records, make, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"), buckets=4)
    store.upsert(records(make.daily("2023-12-01", 90)))
    plan = store.station_range("1082", date(2024, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "year_text" in plan


def test_trailing_window_of_all_stations(records, make):
    rows = make.daily("2024-01-01", 30) + [
        {**r, "indicativo": "B"} for r in make.daily("2023-01-01", 20)
    ]
    counts = {
        r.idema: (r.n, r.first)
        for r in trailing_window(records(rows), 5)
        .groupBy("idema")
        .agg(F.count("*").alias("n"), F.min("fecha").alias("first"))
        .collect()
    }
    assert counts == {"1082": (6, "2024-01-25"), "B": (6, "2023-01-15")}


def test_stream_equals_batch(spark, make, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    batches = [make.daily("2024-01-01", 40), make.daily("2024-01-20", 40, prec="7,0")]
    for i, batch in enumerate(batches):
        (landing / f"part_{i}.json").write_text("\n".join(map(json.dumps, batch)))
    streamed = RecordStore(spark, str(tmp_path / "streamed"), buckets=2)
    stream_upsert(spark, str(landing), streamed, str(tmp_path / "progress")).awaitTermination()
    (landing / "part_2.json").write_text(json.dumps(make.raw("2024-01-05", prec="3,3")))
    stream_upsert(spark, str(landing), streamed, str(tmp_path / "progress")).awaitTermination()
    batch = RecordStore(spark, str(tmp_path / "batch"), buckets=2)
    batch.upsert(read_lines(spark, str(landing)))
    assert sorted(map(str, streamed.read().collect())) == sorted(map(str, batch.read().collect()))
    assert streamed.read().count() == 59


def test_tiles(spark):
    requests = spark.createDataFrame(
        [("a", "2020-08-31", "2021-10-01"), ("b", "2020-01-01", "2020-07-02"),
         ("c", "2020-01-01", "2020-01-01"), ("d", "1949-12-01", "2025-02-25")],
        "idema string, s string, e string",
    ).selectExpr("idema", "to_date(s) as start", "to_date(e) as end")
    found = {}
    for r in backfill_tiles(requests).orderBy("idema", "tile").collect():
        found.setdefault(r.idema, []).append((str(r.start), str(r.end)))
    assert found["a"] == [("2020-08-31", "2021-02-28"), ("2021-03-01", "2021-09-01"), ("2021-09-02", "2021-10-01")]
    # One day is left over and lost.
    assert found["b"] == [("2020-01-01", "2020-07-01")]
    assert "c" not in found
    assert len(found["d"]) > 100 and found["d"][-1][1] == "2025-02-25"


def test_station_dimension(spark, series):
    assert stations(spark).count() == 5
    paths = [r.path for r in station_shards(spark).filter("city = 'Malaga'").orderBy("shard").collect()]
    assert len(paths) == 8 and paths[0] == "./data/Malaga/historical_climate_data_Malaga_1.json"
    assert shard_glob("Madrid").endswith("Madrid_*.json")
    (row,) = with_city(series({"3195": {0: (1, 2)}})).collect()
    assert row.city == "Madrid"


def test_store_keeps_its_buckets(spark, records, make, tmp_path):
    rows = [make.raw("2024-01-01", indicativo=f"s{i}", prec="1,0") for i in range(12)]
    path = str(tmp_path / "store")
    RecordStore(spark, path, buckets=4).upsert(records(rows))
    again = RecordStore(spark, path)
    assert again.buckets == 4
    assert all(again.station_range(f"s{i}").count() == 1 for i in range(12))
    again.upsert(records(rows))
    assert again.read().count() == 12


def test_shards_with_repeated_keys_and_odd_elements(spark, tmp_path):
    (tmp_path / "a_0.json").write_text(
        '[{"fecha": "2024-01-01", "indicativo": "1", "prec": "1,0", "prec": "2,0"}, 5, null,'
        ' {"fecha": "2024-01-02", "indicativo": "1", "prec": null}]'
    )
    (tmp_path / "b_0.json").write_text('{"fecha": "2024-01-01"}')
    (tmp_path / "c_0.json").write_text('[{"fecha": ')
    loaded = read_shards_tolerant(spark, str(tmp_path))
    assert loaded.records.count() == 2
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in loaded.rejected.collect()}
    assert errors == {"b_0.json": "not a JSON array", "c_0.json": "not valid JSON"}


def day_values(store, version=None):
    return {(r.idema, r.fecha): r.prec for r in store.read(version).collect()}


def two_stations(make, prec):
    return [
        *make.daily("2022-12-20", 60, prec=prec),
        *[{**r, "indicativo": "B"} for r in make.daily("2024-02-01", 30, prec=prec)],
    ]


@pytest.mark.parametrize("step", ["_write", "_zones_of", "_commit"])
def test_an_upsert_that_dies_leaves_the_old_version_whole(spark, records, make, tmp_path, monkeypatch, step):
    store = RecordStore(spark, str(tmp_path / "store"), buckets=2)
    store.upsert(records(two_stations(make, "1,0")))
    before = day_values(store)
    whole = getattr(RecordStore, step)

    def dies(self, *args):
        if step == "_write":  # one folder is written, the others are not
            placed, snapshot = args
            whole(self, placed.filter("year_text = '2023'"), snapshot)
        raise OSError("executor lost")

    monkeypatch.setattr(RecordStore, step, dies)
    with pytest.raises(OSError):
        store.upsert(records(two_stations(make, "2,0")))
    assert day_values(RecordStore(spark, store.path)) == before and len(before) == 90
    monkeypatch.setattr(RecordStore, step, whole)
    store.upsert(records(two_stations(make, "2,0")))
    assert set(day_values(store).values()) == {"2,0"} and len(day_values(store)) == 90


def test_readers_keep_their_version(spark, records, make, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"), buckets=2)
    store.upsert(records(two_stations(make, "1,0")))
    started = store.read()
    store.upsert(records([make.raw("2023-01-05", prec="7,0")]))
    store.upsert(records([make.raw("2031-01-05", prec="8,0")]))
    assert store.versions() == [1, 2, 3]
    assert {r.prec for r in started.collect()} == {"1,0"}
    assert day_values(store, 2)["1082", "2023-01-05"] == "7,0" and ("1082", "2031-01-05") not in day_values(store, 2)
    files = {v: set(store.read(v).inputFiles()) for v in (1, 2)}
    assert len(files[2] - files[1]) == 1, "an upsert writes only the folder it touches"
    assert store.drop_old(keep=1) == [1, 2] and store.versions() == [3]
    assert len(day_values(store)) == 91 and day_values(store)["1082", "2023-01-05"] == "7,0"
    with pytest.raises(Exception):
        store.read(1)


def test_two_upserts_from_one_version_do_not_mix(spark, records, make, tmp_path, monkeypatch):
    store = RecordStore(spark, str(tmp_path / "store"), buckets=2)
    store.upsert(records([make.raw("2024-01-01", prec="1,0")]))
    first = store.current()
    other = RecordStore(spark, store.path)
    monkeypatch.setattr(other, "current", lambda: first)
    store.upsert(records([make.raw("2024-01-02", prec="2,0")]))
    with pytest.raises(RuntimeError, match="version 2"):
        other.upsert(records([make.raw("2024-01-03", prec="3,0")]))
    assert sorted(day for _, day in day_values(store)) == ["2024-01-01", "2024-01-02"]


def test_zones_name_the_folders_of_a_window(spark, records, make, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"), buckets=4)
    rows = two_stations(make, "1,0")
    store.upsert(records(rows))
    zones = {(r.idema, r.year_text): (r.first_day, r.last_day, r.rows) for r in store.zones().collect()}
    assert zones == {
        ("1082", "2022"): ("2022-12-20", "2022-12-31", 12),
        ("1082", "2023"): ("2023-01-01", "2023-02-17", 48),
        ("B", "2024"): ("2024-02-01", "2024-03-01", 30),
    }
    window = store.trailing_window(10)
    assert sorted(f.split("year_text=")[1][:4] for f in window.inputFiles() if "year_text=" in f) == ["2023", "2024"]
    want = sorted((r.idema, r.fecha) for r in trailing_window(records(rows), 10).collect())
    assert sorted((r.idema, r.fecha) for r in window.collect()) == want and len(want) == 22
    (scan,) = {f.split("year_text=")[1][:4] for f in store.station_range("1082", end=date(2022, 12, 31)).inputFiles()}
    assert scan == "2022"
    assert store.station_range("nowhere").count() == 0
