from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.constants import STEP_SPREAD_MM
from nimbora.functions.scoring import rain_error
from nimbora.operators import metrics
from nimbora.operators.folds import fold_grid, test_rows as rows_after, year_list
from nimbora.operators.split import chart_days, context_slice, resolve_cutoffs, train_test_split


@pytest.mark.parametrize(
    "actual, predicted, want", [([20, 0], [5, 2], 4.75), ([3, 0], [1, 2], 9.0), ([0, 0], [3, 0], 9.0)]
)
def test_rain_error(spark, actual, predicted, want):
    pairs = spark.createDataFrame([(float(a), float(p)) for a, p in zip(actual, predicted)], "a double, p double")
    (row,) = pairs.agg(rain_error(F.col("a"), F.col("p")).alias("e")).collect()
    assert row.e == pytest.approx(want)


def test_fold_grid_has_27_cutoffs_in_any_year(spark):
    grid = fold_grid(year_list(spark, range(1951, 2025)), 14)
    per_year = {r.year: (r.n, r.first, r.last) for r in grid.groupBy("year").agg(
        F.count("*").alias("n"), F.min("cutoff").alias("first"), F.max("cutoff").alias("last")).collect()}
    assert {n for n, _, _ in per_year.values()} == {27} and grid.count() == 1998
    assert per_year[2023][1:] == (date(2022, 12, 31), date(2023, 12, 30))
    assert per_year[2024][1:] == (date(2023, 12, 31), date(2024, 12, 29))


def test_fold_grid_bounds(spark):
    years = year_list(spark, [2023])
    days = [r.start_day for r in fold_grid(years, 14, 10, 40).orderBy("start_day").collect()]
    assert days == [10, 24, 38]
    assert fold_grid(years, 14, 0, 0).count() == 27
    assert fold_grid(years, 14, 300, 20).count() == 0


def predictions(spark, rows):
    return spark.createDataFrame(
        [("c", "a", y, f, date(y, 1, 1), s, date(y, 1, 1 + s), p, t) for y, f, s, p, t in rows],
        "config_id string, idema string, year int, fold_id int, cutoff date, step int, date date, "
        "prediction double, actual double",
    )


def test_cv_reduction(spark):
    rows = [
        (2000, 1, 1, 1.0, 2.0), (2000, 1, 2, 0.0, 0.0), (2000, 2, 1, 5.0, 1.0), (2000, 2, 2, 1.0, None),
        (2001, 3, 1, 0.0, 1.0), (2001, 4, 1, 3.0, None), (2001, 4, 2, 3.0, None), (2001, 3, 3, 9.0, None),
    ]
    table = predictions(spark, rows)
    folds = {r.fold_id: (r.n, r.mae) for r in metrics.fold_metrics(table).collect()}
    assert folds == {1: (2, 0.5), 2: (1, 4.0), 3: (1, 1.0)}
    (row,) = metrics.cv_summary(metrics.fold_metrics(table)).collect()
    assert row.mae == pytest.approx(np.mean([2.25, 1.0])) and row.mae_std == pytest.approx(0.625)
    spread = {r.step: r.sd for r in metrics.residual_spread(table).collect()}
    assert spread == {1: pytest.approx(np.std([1.0, -4.0, 1.0])), 2: 0.0, 3: 0.0}
    one_year = metrics.cv_summary(metrics.fold_metrics(table.filter("year = 2000"))).collect()
    assert one_year[0].mae_std == 0.0


def test_pairing_is_by_position_unless_asked(spark):
    forecast = spark.createDataFrame(
        [("a", 1, s, date(2020, 1, s), float(s)) for s in (1, 2, 3)],
        "idema string, fold_id int, step int, date date, prediction double",
    )
    actual = spark.createDataFrame(
        [("a", 1, date(2020, 1, d), float(d)) for d in (2, 3)], "idema string, fold_id int, date date, actual double"
    )
    pairs = {r.step: r.actual for r in metrics.pair_by_position(forecast, actual).collect()}
    assert pairs == {1: 2.0, 2: 3.0}
    pairs = {r.step: r.actual for r in metrics.pair_by_date(forecast, actual).collect()}
    assert pairs == {2: 2.0, 3: 3.0}


def test_window_metrics_cover_the_full_horizon(spark):
    (row,) = metrics.window_metrics(predictions(spark, [(2020, 1, 1, 1.0, 2.0), (2020, 1, 2, 1.0, None)]), 14).collect()
    assert (row.mae_error, str(row.period_start), str(row.period_end)) == (1.0, "2020-01-02", "2020-01-15")


def test_bands_and_levels(spark):
    table = predictions(spark, [(2020, 1, 1, 1.0, None), (2020, 1, 14, 45.0, None)])
    low, high = metrics.forecast_bands(table, metrics.default_spread(spark)).orderBy("step").collect()
    assert low.lower_band == 0.0 and low.upper_band == 1.0 + STEP_SPREAD_MM[0]
    assert (low.level, low.lower_level, low.upper_level) == (0, 0, 2)
    assert (high.level, high.upper_level) == (3, 4)


def test_leaderboard_keeps_the_best_share(spark):
    summary = spark.createDataFrame(
        [(f"c{i}", "a", float(i % 4), 0.0, 0.0) for i in range(6)],
        "config_id string, idema string, mae double, mae_std double, rain_error double",
    )
    ranked = metrics.leaderboard(summary)
    assert [r.config_id for r in ranked.orderBy("rank").collect()] == ["c0", "c4", "c1", "c5", "c2", "c3"]
    assert [r.config_id for r in metrics.best_share(ranked, 6).orderBy("rank").collect()] == ["c0", "c4"]
    assert metrics.best_share(ranked, 6, 1.0).count() == 6


def test_splits_and_slices(spark, series):
    days = series({"a": {d: (d, 0) for d in range(0, 100)}})
    cutoff = date(2020, 2, 29)
    train, test = train_test_split(days, date(2020, 1, 11), cutoff, 14)
    assert (train.count(), test.count()) == (50, 14)
    grid = spark.createDataFrame([(1, cutoff)], "fold_id int, cutoff date")
    assert rows_after(days, grid, 14).count() == 14
    cutoffs = spark.createDataFrame([("a", cutoff)], "idema string, cutoff date")
    context = [r.date for r in context_slice(days, cutoffs, 14).orderBy("date").collect()]
    assert (context[0], context[-1], len(context)) == (date(2020, 1, 30), cutoff, 31)
    assert chart_days(days, cutoffs, 14).count() == 45
    assert resolve_cutoffs(days).collect()[0].cutoff == date(2020, 4, 9)
    assert resolve_cutoffs(days, date(2020, 3, 1)).collect()[0].cutoff == cutoff
