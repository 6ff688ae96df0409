from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nimbora.operators.asof import asof_features, features_at, reachable
from nimbora.operators.bands import band_join
from nimbora.operators.bulk import bulk_features, feature_table, rolling_week, short_stations
from nimbora.operators.seasonality import seasonality
from nimbora.operators.specs import KINDS, FeatureConfig, Spec

PRECIPITATION, HUMIDITY = "precipitation", "average_humidity"


def column(df, name):
    return [getattr(r, name) for r in df.orderBy("idema", "date").collect()]


def random_days(days, keep, seed):
    rng = np.random.default_rng(seed)
    kept = np.flatnonzero(rng.random(days) < keep)
    return {int(d): (round(rng.gamma(0.4, 8), 1), float(rng.integers(40, 100))) for d in kept}


def test_gappy_rows_use_row_shifts(series):
    days = series({"a": {1: (3, 0), 2: (5, 0), 5: (9, 0), 6: (1, 0)}})
    found = bulk_features(days, [Spec(PRECIPITATION, "std", 3), Spec(PRECIPITATION, "lag", 2)])
    assert column(found, "precipitation_rolling_3d_std") == pytest.approx([0, 1.414214, 3.055050, 4.0], abs=1e-6)
    assert column(found, "precipitation_lag_2d") == [0, 0, 3, 5]


def test_the_two_feature_families_differ(series):
    days = series({"a": {1: (3, 0), 2: (5, 0), 5: (9, 0), 6: (1, 0)}})
    specs = [Spec(PRECIPITATION, "sum", 2), Spec(PRECIPITATION, "lag", 1)]
    assert column(bulk_features(days, specs), "precipitation_rolling_2d_sum") == [3, 8, 14, 10]
    assert column(asof_features(days, specs), "precipitation_rolling_2d_sum") == [0, 3, 0, 9]
    assert column(bulk_features(days, specs), "precipitation_lag_1d") == [0, 3, 5, 9]
    assert column(asof_features(days, specs), "precipitation_lag_1d") == [0, 3, 0, 9]
    free = bulk_features(days, specs, leak_free=True)
    assert column(free, "precipitation_rolling_2d_sum") == [0, 3, 8, 14]


def test_long_station_equals_one_window_over_the_whole_series(series):
    """Several blocks, and years with fewer rows than a window, against pandas."""
    days = random_days(5000, 0.8, 1) | {6000: (4.0, 50.0), 7500: (1.5, 60.0), 7501: (2.5, 61.0)}
    specs = [Spec(c, k, n) for c in (PRECIPITATION, HUMIDITY) for k in KINDS for n in (3, 25)]
    found = bulk_features(series({"a": days, "b": {0: (1, 1)}}), specs).toPandas()
    found = found[found.idema == "a"].sort_values("date").reset_index(drop=True)
    for spec in specs:
        base = found[spec.column]
        rolling = base.rolling(spec.window, min_periods=1)
        want = base.shift(spec.window) if spec.kind == "lag" else getattr(rolling, spec.kind)()
        np.testing.assert_allclose(found[spec.name], want.fillna(0), atol=1e-6)
    assert list(found.row_index) == list(range(1, len(days) + 1))


def brute_asof(history, day, spec):
    if spec.kind == "lag":
        return history.get(day - spec.window, 0.0)
    seen = [history[d] for d in range(day - spec.window, day) if d in history]
    if spec.kind == "std":
        return float(np.std(seen, ddof=1)) if len(seen) > 1 else 0.0
    if not seen:
        return 0.0
    return float({"mean": np.mean, "max": max, "min": min, "sum": sum}[spec.kind](seen))


def test_date_based_features_against_brute_force(series):
    days = random_days(3200, 0.5, 2)
    specs = [Spec(PRECIPITATION, k, n) for k in KINDS for n in (2, 14)]
    found = asof_features(series({"a": days}), specs).orderBy("date").toPandas()
    history = {d: p for d, (p, _) in days.items()}
    for spec in specs:
        want = [brute_asof(history, d, spec) for d in sorted(days)]
        np.testing.assert_allclose(found[spec.name], want, atol=1e-9)


def test_future_rows_see_history_only(spark, series):
    days = {d: (d, 2 * d) for d in (1, 2, 4, 9)}
    targets = spark.createDataFrame(
        [("a", date(2020, 1, 1) + timedelta(days=d)) for d in (3, 4, 10, 11, 30)], "idema string, date date"
    )
    specs = [Spec(PRECIPITATION, k, 3) for k in KINDS]
    found = features_at(targets, series({"a": days}), specs, ["month"]).orderBy("date").toPandas()
    history = {d: float(d) for d in days}
    for spec in specs:
        want = [brute_asof(history, d, spec) for d in (3, 4, 10, 11, 30)]
        np.testing.assert_allclose(found[spec.name], want)
    assert list(found.month) == [1] * 5


def test_a_present_day_without_value_is_not_an_absent_day(spark):
    rows = [("a", date(2020, 1, 1), 1.0), ("a", date(2020, 1, 2), None), ("a", date(2020, 1, 3), 4.0)]
    days = spark.createDataFrame(rows, "idema string, date date, precipitation double")
    found = asof_features(days, [Spec(PRECIPITATION, "lag", 1), Spec(PRECIPITATION, "std", 2)])
    assert column(found, "precipitation_lag_1d") == [0.0, 1.0, None]
    assert column(found, "precipitation_rolling_2d_std") == [0.0, 0.0, None]


def test_warm_up_rows_are_dropped_by_position(series):
    config = FeatureConfig("c", (Spec(PRECIPITATION, "lag", 3),), ("day_of_year", "week_of_year"))
    days = series({"a": {d: (d, 0) for d in (0, 5, 6, 40, 41)}, "short": {0: (1, 1), 1: (1, 1), 2: (1, 1)}})
    table = feature_table(days, config)
    assert [(r.idema, r.day_of_year, r.precipitation_lag_3d) for r in table.orderBy("date").collect()] == [
        ("a", 41, 0.0),
        ("a", 42, 5.0),
    ]
    assert [r.idema for r in short_stations(days, 3).collect()] == ["short"]


def test_seasonality(series):
    days = series({"a": {0: (1, 0), 1: (2, 0), 366: (10, 0)}})
    assert column(rolling_week(days), "week_sum") == [1, 3, 13]
    found = {r.day_of_year: r.week_sum for r in seasonality(days).collect()}
    assert found == {1: 7.0, 2: 3.0}


def test_all_windows_share_one_exchange(spark, series, tmp_path):
    days = random_days(100, 1.0, 3)
    path = str(tmp_path / "series")
    indexed = bulk_features(series({"a": days}), [])
    indexed.write.parquet(path)
    config = FeatureConfig("c", tuple(Spec(PRECIPITATION, k, n) for k in KINDS for n in (3, 14)))
    plan = feature_table(spark.read.parquet(path), config)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_specs_are_checked():
    for bad in (("rain", "lag", 1), (PRECIPITATION, "median", 3), (PRECIPITATION, "lag", 0)):
        with pytest.raises(ValueError):
            Spec(*bad)
    with pytest.raises(ValueError, match="calendar"):
        FeatureConfig("c", (), ("weekday",))
    assert Spec(PRECIPITATION, "std", 14).name == "precipitation_rolling_14d_std"
    assert pd.Series([Spec(PRECIPITATION, "lag", 14).name])[0] == "precipitation_lag_14d"


@pytest.mark.parametrize("first, last", [(-25, -1), (-51, 14), (0, 0), (3, 9)])
def test_band_join_against_all_pairs(spark, series, first, last):
    days = {"a": random_days(400, 0.7, 41), "b": random_days(60, 0.9, 42), "c": {-30: (1, 1)}}
    rows = series(days).select("idema", "date", "precipitation")
    asked = [("a", d) for d in (-5, 0, 17, 18, 200, 399, 420)] + [("b", 59), ("b", 60), ("none", 3)]
    start = date(2020, 1, 1)
    targets = spark.createDataFrame(
        [(s, start + timedelta(days=d)) for s, d in asked] + [("a", None)], "idema string, cutoff date"
    )
    want = sorted(
        (s, d, t) for s, own in days.items() for d in own for x, t in asked if x == s and t + first <= d <= t + last
    )
    both = band_join(rows, targets, F.col("date"), F.col("cutoff"), first, last)
    assert both.columns == ["idema", "date", "precipitation", "cutoff"]
    got = sorted((r.idema, (r.date - start).days, (r.cutoff - start).days) for r in both.collect())
    assert got == want
    once = band_join(rows, targets, F.col("date"), F.col("cutoff"), first, last, "left_semi")
    assert sorted((r.idema, (r.date - start).days) for r in once.collect()) == sorted({w[:2] for w in want})


def test_forecast_features_window_only_what_they_reach(spark, series):
    days = {s: random_days(500, 1.0, 43) for s in "ab"}
    rows = series(days)
    last = date(2020, 1, 1) + timedelta(days=499)
    ahead = spark.createDataFrame(
        [(s, last + timedelta(days=d)) for s in "ab" for d in range(1, 15)], "idema string, date date"
    )
    kept = reachable(rows, ahead, 25).groupBy("idema").count().collect()
    assert [r["count"] for r in kept] == [25, 25]
