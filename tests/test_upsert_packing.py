"""Texts packed for the shuffle of an upsert come back as they were, and take less of it."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from catalog import queries
from nimbora.constants import DAY, KEY, METRIC_FIELDS
from nimbora.functions.packing import pack_texts, split_texts, unpack_texts
from nimbora.operators.upsert import latest_records
from nimbora.sources import store as store_module
from nimbora.sources.store import RecordStore

ODD = ["", None, "\x1f", "\x1b", "\x1bn", "\x1bs\x1f", "\x1be", "Ip", "0,0", "ñ\x1f\x1b\x1f", " ", "\n"]


def test_packed_texts_come_back(spark):
    rows = [(a, b, c) for a in ODD for b in ODD for c in (None, "", "x")]
    given = spark.createDataFrame(rows, "a string, b string, c string").repartition(3)
    names = ["a", "b", "c"]
    parts = given.select(split_texts(pack_texts(names)).alias("p")).localCheckpoint()
    again = parts.select(*unpack_texts(F.col("p"), names)).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, rows))


def _records(spark, rows):
    schema = f"{KEY} string, {DAY} string, {', '.join(f'{m} string' for m in METRIC_FIELDS)}, null_keys array<string>, arrival int"
    return spark.createDataFrame(rows, schema)


def test_last_arrival_keeps_nulls_blanks_and_column_order(spark):
    texts = tuple((ODD * 2)[: len(METRIC_FIELDS)])
    rows = [("A", "2020-01-01", *texts[::-1], None, 1), ("A", "2020-01-01", *texts, ["prec"], 2), ("", "2020-01-01", *texts, [], 9)]
    records = _records(spark, rows)
    latest = latest_records(records)
    assert latest.columns == records.columns[:-1]
    assert [tuple(r) for r in latest.collect()] == [("A", "2020-01-01", *texts, ["prec"])]
    assert latest_records(records, columns=["dir", "prec"]).columns == [KEY, DAY, "dir", "prec"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffled_rows_hold_one_text(spark):
    rows = [("A", f"2020-01-{d:02d}", *["1,5"] * len(METRIC_FIELDS), [], d) for d in range(1, 9)]
    plan = _plan(latest_records(_records(spark, rows), columns=METRIC_FIELDS))
    winners = [line for line in plan.splitlines() if "partial_max_by" in line]
    assert winners and not any(f in line for line in winners for f in ("tmin", "velmedia"))


def test_store_writes_rows_that_travel_packed(spark, tmp_path, monkeypatch):
    rows = [("A", f"2020-01-{d:02d}", *["1,5"] * len(METRIC_FIELDS), [], d) for d in range(1, 9)]
    seen, write = [], RecordStore._write

    def spied(self, records, snapshot):
        seen.append(records.columns)
        write(self, records, snapshot)

    monkeypatch.setattr(RecordStore, "_write", spied)
    store = RecordStore(spark, str(tmp_path / "store"), buckets=2)
    store.upsert(_records(spark, rows[:5]))
    store.upsert(_records(spark, rows[3:]))
    assert len(seen) == 2 and not set(seen[0] + seen[1]) & set(METRIC_FIELDS)
    got = store.read().select(KEY, DAY, *METRIC_FIELDS).collect()
    assert sorted(map(tuple, got)) == sorted(r[:-2] for r in rows)


def test_records_travel_to_the_store_once(spark, tmp_path, monkeypatch):
    rows = [("A", f"2020-01-{d:02d}", *["1,5"] * len(METRIC_FIELDS), [], d) for d in range(1, 9)]
    plans, write = [], RecordStore._write

    def spied(self, records, snapshot):
        plans.append(_plan(records))
        write(self, records, snapshot)

    monkeypatch.setattr(RecordStore, "_write", spied)
    store = RecordStore(spark, str(tmp_path / "store"), buckets=2)
    store.upsert(_records(spark, rows[:5]))
    store.upsert(_records(spark, rows[3:]))
    assert [p.count("Exchange ") for p in plans] == [1, 1], plans
    assert all("rangepartitioning" in p for p in plans)


def test_crowded_keys_are_thinned_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "CROWD_ROWS", 20)
    plans, write = [], RecordStore._write

    def spied(self, records, snapshot):
        plans.append(_plan(records))
        write(self, records, snapshot)

    monkeypatch.setattr(RecordStore, "_write", spied)
    days = [f"2020-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in range(1, 28)]
    rows = [("A", day, *[f"{i},5"] * len(METRIC_FIELDS), [], i) for i, day in enumerate(days)]
    much = [("A", days[4], *[f"{i},0"] * len(METRIC_FIELDS), [], i) for i in range(100, 300)]
    store = RecordStore(spark, str(tmp_path / "store"), buckets=1)
    assert store.upsert(_records(spark, much + rows)) == len(rows) + len(much)
    assert store.upsert(_records(spark, [(*r[:-1], r[-1] - 500) for r in much])) == len(much)
    assert len(plans) == 2 and all(p.count("Exchange ") == 2 for p in plans), plans
    got = {r[DAY]: r["prec"] for r in store.read().collect()}
    assert got == {r[1]: r[2] for r in rows} | {days[4]: "299,0"} and len(got) == len(days)


@pytest.fixture()
def lines(spark, tmp_path):
    first = date(2000, 1, 1)
    rows = [(i, 1, 7, i % 2, 100.0 + i, first + timedelta(days=i)) for i in range(80)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_upsert_of_wind_sectors_carries_wind_alone(spark, lines):
    assert "presMax" not in _plan(queries.wind_sector(spark, lines))


def test_trailing_window_is_taken_before_the_upsert(spark, lines):
    window = queries.trailing(spark, lines)
    plan = _plan(window)
    assert plan.index("max_by") < plan.index("Join")
    assert window.count() == 52


def test_future_features_read_the_lines_once(spark, lines):
    assert "lineitem" not in _plan(queries.future_features(spark, lines))


def test_steps_are_paired_before_their_values_are_looked_up(spark, lines):
    rows = queries.residual_rows(spark, lines)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Join Inner")
    assert rows.count() == 80
