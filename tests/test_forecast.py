from datetime import date, timedelta
from functools import partial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from nimbora.operators import learners
from nimbora.operators.bulk import feature_table, indexed
from nimbora.operators.clean import clean_daily
from nimbora.operators.folds import cutoff_grid, fold_grid, year_list
from nimbora.operators.learners import FittedModel, expanding_least_squares, fit_boosted_trees, fit_tweedie
from nimbora.operators.recursion import linear_path, transform_path
from nimbora.operators.specs import DEFAULT_CONFIG, KINDS, LOOKBACK_DAYS, FeatureConfig, Spec
from nimbora.plans.benchmark import run_benchmark, union_features
from nimbora.plans.predict import (
    export_model,
    fit_at,
    forecast_from_bundle,
    forecast_saved,
    forecast_states,
    inference_data_window,
    predict_dates,
    predict_dates_with,
    report,
    run_forecast,
    run_prediction,
)
from nimbora.plans.search import exploration_configs, explore_configs, random_config_table
from nimbora.sources.bundle import Manifest, load_bundle, load_config, parse_manifest, save_bundle
from test_features import brute_asof, random_days

START = date(2020, 1, 1)
P, H = "precipitation", "average_humidity"


def brute_path(config, weights, history, cutoff):
    """Plain-Python recursion: {column: {day: value}} histories, target filled as it goes."""
    target = {d: v for d, v in history[P].items() if d <= cutoff}
    other = {d: v for d, v in history[H].items() if d <= cutoff}
    path = []
    for step in range(1, config.horizon + 1):
        x = cutoff + step
        values = [brute_asof(target if s.column == P else other, x, s) for s in config.specs]
        values.append((START + timedelta(days=x)).timetuple().tm_yday)
        path.append(max(0.0, weights[0] + float(np.dot(weights[1:], values))))
        target[x] = path[-1]
    return path


def histories(days):
    return {P: {d: p for d, (p, _) in days.items()}, H: {d: h for d, (_, h) in days.items()}}


def all_kinds():
    return FeatureConfig("all", tuple(Spec(P, k, n) for k in KINDS for n in (3, 9)), horizon=6)


def weights_of(config):
    rng = np.random.default_rng(7)
    return [2.0, *rng.normal(0, 0.1, len(config.columns) - 1), 0.01]


def test_recursive_path_against_plain_python(spark, series):
    config, days = all_kinds(), random_days(120, 0.6, 5)
    weights = weights_of(config)
    state = forecast_states(series({"a": days}), config, START + timedelta(days=80))
    arrays = {c: F.col(c) for c in config.inputs}
    path = linear_path(config, arrays, F.col("cutoff"), F.lit(weights[0]), F.array(*map(F.lit, weights[1:])))
    (row,) = state.select(path.alias("path"), "observed").collect()
    warm = sorted(days)[config.warmup:]
    kept = {d: days[d] for d in warm}
    np.testing.assert_allclose(row.path, brute_path(config, weights, histories(kept), 80), atol=1e-9)
    assert row.observed == [days[d][0] for d in warm if 80 < d <= 86]


def test_other_columns_stop_at_the_cutoff(series):
    config = FeatureConfig("h", (Spec(H, "lag", 14), Spec(H, "mean", 14), Spec(H, "sum", 5), Spec(H, "max", 3)))
    days = {d: (1.0, float(d)) for d in range(60)}
    state = forecast_states(series({"a": days}), config, START + timedelta(days=50))
    arrays = {c: F.col(c) for c in config.inputs}

    def alone(i):
        weights = F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(len(config.columns))])
        return linear_path(config, arrays, F.col("cutoff"), F.lit(0.0), weights)

    row = state.select(*[alone(i).alias(f"f{i}") for i in range(4)]).collect()[0]
    assert row.f0 == [float(d) for d in range(37, 51)]
    assert row.f1 == [pytest.approx(np.mean(range(36 + s, 51))) for s in range(1, 15)]
    assert row.f2[:6] == [240.0, 194.0, 147.0, 99.0, 50.0, 0.0]
    assert row.f3[:5] == [50.0, 50.0, 50.0, 0.0, 0.0]


def test_short_lags_of_other_columns_are_refused(series):
    config = FeatureConfig("h", (Spec(H, "lag", 13),))
    with pytest.raises(ValueError, match="horizon"):
        config.check_recursion()
    FeatureConfig("p", (Spec(P, "lag", 1),)).check_recursion()


def test_mllib_path_equals_linear_path(series):
    config, days = all_kinds(), random_days(200, 0.8, 6)
    rows = series({"a": days, "b": random_days(200, 0.7, 8)})
    train = VectorAssembler(inputCols=config.columns, outputCol="features").transform(feature_table(rows, config))
    model = LinearRegression(labelCol=P, regParam=0.1).fit(train)
    state = forecast_states(rows, config, START + timedelta(days=150))
    stepped = transform_path(state, config, config.inputs, model)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (state, stepped)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")
    arrays = {c: F.col(c) for c in config.inputs}
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    at_once = state.select("idema", linear_path(config, arrays, F.col("cutoff"), F.lit(model.intercept), weights).alias("path"))
    want = {r.idema: r.path for r in at_once.collect()}
    for row in stepped.collect():
        np.testing.assert_allclose(row.path, want[row.idema], atol=1e-9)


def brute_fits(table, columns, cutoffs):
    fits = {}
    for cutoff in cutoffs:
        train = table[table.date <= cutoff]
        if len(train):
            x = np.column_stack([np.ones(len(train)), train[columns].to_numpy(float)])
            fits[cutoff] = (len(train), np.linalg.lstsq(x, train[P].to_numpy(), rcond=None)[0])
    return fits


def test_expanding_least_squares_against_numpy(spark, series):
    config = FeatureConfig("c", (Spec(P, "lag", 14), Spec(H, "lag", 14), Spec(P, "std", 5)))
    rows = series({"a": random_days(900, 0.7, 9), "b": random_days(500, 0.9, 10)})
    grid = fold_grid(year_list(spark, range(2020, 2023)), 14)
    table = feature_table(rows, config)
    fits = expanding_least_squares(table, grid, [config]).toPandas()
    cutoffs = sorted({r.cutoff for r in grid.collect()})
    pdf = table.toPandas()
    for station, part in pdf.groupby("idema"):
        want = brute_fits(part, config.columns, cutoffs)
        got = fits[fits.idema == station].set_index("cutoff")
        assert set(got.index) == set(want)
        for cutoff, (n, beta) in want.items():
            assert got.loc[cutoff, "n_train"] == n
            if n > 20:
                found = [got.loc[cutoff, "intercept"], *got.loc[cutoff, "coefficients"]]
                np.testing.assert_allclose(found, beta, rtol=1e-6, atol=1e-8)


def test_dependent_inputs_do_not_break_the_fit(spark, series):
    config = FeatureConfig("c", (Spec(P, "mean", 2), Spec(P, "sum", 2)), ())
    rows = series({"a": {d: (d % 7, 50) for d in range(300)}})
    grid = cutoff_grid(spark, [date(2020, 9, 1)])
    (fit,) = expanding_least_squares(feature_table(rows, config), grid, [config]).collect()
    table = feature_table(rows, config).filter(F.col("date") <= date(2020, 9, 1)).toPandas()
    x = np.column_stack([np.ones(len(table)), table[config.columns]])
    want = x @ np.linalg.lstsq(x, table[P], rcond=None)[0]
    np.testing.assert_allclose(x @ [fit.intercept, *fit.coefficients], want, atol=1e-8)
    assert sum(fit.importances) == pytest.approx(1.0)


def test_benchmark_against_a_fold_by_fold_loop(spark, series):
    """Two configs with different warm-ups, gaps, and a fold without test rows."""
    configs = [
        FeatureConfig("lag", (Spec(P, "lag", 14),)),
        FeatureConfig("more", (Spec(P, "lag", 14), Spec(P, "std", 25), Spec(H, "lag", 14))),
    ]
    days = {d: v for d, v in random_days(800, 0.85, 11).items() if not 500 <= d < 530}
    rows = series({"a": days})
    result = run_benchmark(rows, configs, [2020, 2021])
    got = {(r.config_id, r.fold_id): r for r in result.folds.collect()}
    grid = fold_grid(year_list(spark, [2020, 2021]), 14).collect()
    maes, residuals = {}, {}
    for config in configs:
        pdf = feature_table(rows, config).toPandas()
        kept = {(d - START).days: days[(d - START).days] for d in pdf.date}
        fits = brute_fits(pdf, config.columns, [g.cutoff for g in grid])
        for fold in grid:
            if fold.cutoff not in fits:
                continue
            n, beta = fits[fold.cutoff]
            if n <= len(config.columns) + 1:
                continue
            k = (fold.cutoff - START).days
            path = brute_path(config, beta, histories(kept), k)
            actual = [kept[d][0] for d in sorted(kept) if k < d <= k + 14]
            if not actual:
                assert (config.config_id, fold.fold_id) not in got
                continue
            row = got[config.config_id, fold.fold_id]
            error = np.array(actual) - path[: len(actual)]
            assert row.n == len(actual) and row.mae == pytest.approx(np.abs(error).mean(), rel=1e-6)
            maes.setdefault((config.config_id, fold.year), []).append(row.mae)
    board = result.leaderboard.orderBy("rank").collect()
    assert [r.rank for r in board] == [1, 2] and board[0].mae <= board[1].mae
    assert result.residual_spread.count() == 28
    assert {r.feature for r in result.importance.filter("config_id = 'more'").collect()} == set(configs[1].columns)


def test_benchmark_training_start(series):
    config = FeatureConfig("lag", (Spec(P, "lag", 14),))
    rows = series({"a": random_days(700, 1.0, 12)})
    late = run_benchmark(rows, [config], [2021], training_min_date=date(2021, 3, 1))
    assert min(r.cutoff for r in late.folds.collect()) >= date(2021, 3, 1)
    with pytest.raises(ValueError, match="horizon"):
        run_benchmark(rows, [config, FeatureConfig("x", config.specs, horizon=7)], [2021])


FEW = partial(fit_boosted_trees, maxIter=3)


CYCLE = {d: (d % 5, 70 + d % 3) for d in range(80)}


@pytest.mark.parametrize("learner, days", [(FEW, CYCLE), (fit_tweedie, random_days(80, 1.0, 20))])
def test_fit_then_forecast_equals_one_go(series, learner, days):
    rows = series({"a": days})
    cutoff = START + timedelta(days=70)
    apart = run_forecast(rows, fit_at(rows, DEFAULT_CONFIG, cutoff, learner), DEFAULT_CONFIG, cutoff)
    at_once = run_prediction(rows, cutoff, DEFAULT_CONFIG, learner)
    first, second = ([r.prediction for r in x.orderBy("step").collect()] for x in (apart, at_once))
    assert first == second and len(first) == 14 and min(first) >= 0
    assert [r.actual for r in apart.orderBy("step").collect()][8:] == [days[79][0], *[None] * 5]


def test_a_forecast_works_out_its_series_once(spark, monkeypatch):
    from nimbora.plans import predict

    seen = []
    monkeypatch.setattr(predict, "fit_at", lambda series, *_: seen.append(series))
    monkeypatch.setattr(predict, "run_forecast", lambda series, *_: seen.append(series) or series)
    given = spark.range(5).withColumnRenamed("id", "row_index")
    assert sorted(r[0] for r in run_prediction(given, START).collect()) == list(range(5))
    assert seen[0] is seen[1] and all("nimbora-series" in f for f in seen[0].inputFiles()) and seen[0].inputFiles()


def text_records(days):
    return [
        {"indicativo": "1082", "fecha": (START + timedelta(days=d)).isoformat(),
         "prec": str(p).replace(".", ","), "hrMedia": str(int(h))}
        for d, (p, h) in days.items()
    ]


def test_bundle_round_trip_and_trailing_window(spark, records, tmp_path):
    from nimbora.operators.clean import clean_daily

    stored = records(text_records(random_days(200, 1.0, 13))).persist()
    full = clean_daily(stored, row_index=True, columns=DEFAULT_CONFIG.inputs)
    cutoff = START + timedelta(days=150)
    fitted = fit_at(full, DEFAULT_CONFIG, cutoff, FEW)
    manifest = Manifest(fitted.name, 28, START, cutoff, 14, fitted.feature_columns, ["day_of_year"])
    save_bundle(spark, fitted, manifest, str(tmp_path / "bundle"))
    loaded, checked = load_bundle(spark, str(tmp_path / "bundle"))
    assert checked == manifest and loaded.feature_columns == DEFAULT_CONFIG.columns
    whole = run_forecast(full, fitted, DEFAULT_CONFIG, cutoff).orderBy("step").collect()
    # Nothing is missing in the window, so its fill values do not matter.
    trailing = forecast_from_bundle(stored, loaded, checked, DEFAULT_CONFIG).orderBy("step").collect()
    assert [r.prediction for r in trailing] == [r.prediction for r in whole]
    (row,) = report(forecast_from_bundle(stored, loaded, checked, DEFAULT_CONFIG)).collect()
    assert row.period_end == cutoff + timedelta(days=14)
    importance = fitted.importances(spark).collect()
    assert len(importance) == 8 and importance[0].importance >= importance[-1].importance
    with pytest.raises(FileNotFoundError, match="Missing model"):
        load_bundle(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="other features"):
        run_forecast(full, FittedModel("x", fitted.model, ["a"]), DEFAULT_CONFIG, cutoff)


def test_export_trains_to_the_day_before_or_on_everything(spark, series, tmp_path):
    rows = series({"a": random_days(120, 1.0, 17)})
    until = export_model(rows, str(tmp_path / "until"), date(2020, 4, 1), learner=FEW)
    every = export_model(rows, str(tmp_path / "every"), learner=FEW)
    assert (until.min_date, until.max_date) == (date(2020, 1, 26), date(2020, 3, 31))
    assert every.max_date == START + timedelta(days=119)
    fitted, manifest = load_bundle(spark, str(tmp_path / "until"))
    again = fit_at(rows, DEFAULT_CONFIG, until.max_date, FEW)
    first, second = (
        [r.prediction for r in run_forecast(rows, m, DEFAULT_CONFIG, until.max_date).orderBy("step").collect()]
        for m in (fitted, again)
    )
    assert manifest == until and first == second


def test_inference_window_is_twice_the_longest_feature():
    first, last = inference_data_window(date(2025, 2, 25))
    assert (date(2025, 2, 25) - first).days == LOOKBACK_DAYS == 51 and last == date(2025, 3, 11)


def test_forecasts_for_listed_days(series):
    rows = series({"a": random_days(300, 0.9, 14), "b": random_days(300, 0.9, 15)})
    days = [date(2020, 8, 1), date(2020, 10, 1)]
    found = predict_dates(rows, days).groupBy("idema", "cutoff").agg(F.count("*").alias("n"), F.min("date").alias("d"))
    assert sorted((r.n, r.d) for r in found.collect()) == [(14, d) for d in sorted(days * 2)]
    assert predict_dates_with(rows, days[:1], fit_tweedie).count() == 28


@pytest.mark.parametrize(
    "change, message",
    [
        ({"version": 99}, "Unsupported manifest version: 99"),
        ({"model_name": 1}, "manifest.model_name must be a str"),
        ({"seed": "28"}, "manifest.seed must be an int"),
        ({"feature_columns": ["a", None]}, "manifest.feature_columns"),
        ({"min_date": "soon"}, "Invalid isoformat string: soon"),
    ],
)
def test_manifest_rules(spark, change, message):
    import json

    manifest = Manifest("BoostedTrees", 28, START, START, 14, ["a"], [])
    assert parse_manifest(spark, manifest.to_json()) == manifest
    with pytest.raises(ValueError, match=message):
        parse_manifest(spark, json.dumps(json.loads(manifest.to_json()) | change))
    with pytest.raises(ValueError, match="root must be"):
        parse_manifest(spark, "[]")


def test_random_configs_are_seeded_and_in_bounds(spark, series):
    configs = exploration_configs(spark, [DEFAULT_CONFIG], 20)
    again = exploration_configs(spark.newSession(), [DEFAULT_CONFIG], 20)
    assert configs == again and len(configs) == 21 and exploration_configs(spark, [DEFAULT_CONFIG], 0) == [DEFAULT_CONFIG]
    assert random_config_table(spark, 3, seed=1).collect() != random_config_table(spark, 3, seed=2).collect()
    for config in configs[1:]:
        columns = {s.column for s in config.specs}
        assert 2 <= len(columns) <= 5 and config.calendar == ("day_of_year",) and config.horizon == 14
        for column in columns:
            kinds = {s.kind for s in config.specs if s.column == column}
            assert 1 <= len(kinds) <= 2
            for kind in kinds:
                windows = [s.window for s in config.specs if (s.column, s.kind) == (column, kind)]
                assert windows in ([14], [14, 16, 18, 20])


def test_search_keeps_the_best_share(spark, series, tmp_path):
    rows = series({"a": random_days(500, 1.0, 16)})
    initial = [FeatureConfig("one", (Spec(P, "lag", 14),)), FeatureConfig("two", (Spec(P, "mean", 14),))]
    result, best = explore_configs(rows, initial, 0, years=[2021], year_max_day=60)
    kept, _ = explore_configs(rows, initial, 0, years=[2021], year_max_day=60, keep=True)
    assert best.count() == 2 and result.leaderboard.count() == 2
    kept.write(str(tmp_path / "report"))
    boards = [{r.config_id: (r.mae, r.rain_error) for r in b.leaderboard.collect()} for b in (kept, result)]
    assert {c: pytest.approx(v) for c, v in boards[0].items()} == boards[1]
    assert spark.read.parquet(str(tmp_path / "report" / "residual_spread")).count() == 28


def test_sums_and_scans_in_blocks_do_not_change_the_fits(spark, series, monkeypatch):
    """Three configs, two warm-ups, a station that starts late: sums by generated code or in Arrow
    batches, scanned whole or three cutoffs at a time, one config or all."""
    configs = [
        FeatureConfig("lag", (Spec(P, "lag", 14),)),
        FeatureConfig("more", (Spec(P, "lag", 14), Spec(P, "std", 25), Spec(H, "lag", 14))),
        FeatureConfig("humid", (Spec(H, "mean", 5), Spec(P, "lag", 14)), ()),
    ]
    late = {d: v for d, v in random_days(400, 0.8, 31).items() if d > 250}
    rows = series({"a": random_days(400, 0.9, 30), "b": late})
    features = union_features(indexed(rows), configs)
    grid = fold_grid(year_list(spark, [2020]), 14)

    def fits(some, block=256):
        found = learners.expanding_least_squares(features, grid, some, block).collect()
        return {(r.idema, r.config_id, r.cutoff): r for r in found}

    def agree(got, want):
        assert set(got) == set(want)
        for k, r in want.items():
            assert got[k].n_train == r.n_train
            if r.n_train > 20:
                np.testing.assert_allclose([got[k].intercept, *got[k].coefficients], [r.intercept, *r.coefficients], rtol=1e-6, atol=1e-8)

    together = fits(configs)
    agree(fits(configs, block=3), together)
    alone = {}
    for c in configs:
        alone |= fits([c])
    agree(alone, together)
    monkeypatch.setattr(learners, "JVM_COLUMNS", 0)
    agree(fits(configs), together)


def test_a_bundle_holds_all_that_a_forecast_needs(spark, records, make, tmp_path):
    """Tweedie: importances need the spread of the inputs; the forecast needs the feature set."""
    config = FeatureConfig("own", (Spec(P, "lag", 14), Spec(H, "mean", 5)), ("month",), horizon=7)
    rows = [{**r, "prec": f"{i * 7 % 11},{i % 10}", "hrMedia": str(40 + i * 13 % 50)} for i, r in enumerate(make.daily("2024-01-01", 200))]
    stored = records(rows)
    series = clean_daily(stored, row_index=True, columns=config.inputs)
    path = str(tmp_path / "bundle")
    manifest = export_model(series, path, date(2024, 6, 1), config, fit_tweedie)
    fitted, loaded = load_bundle(spark, path)
    assert loaded == manifest and load_config(spark, path, loaded) == config
    shares = {r.feature: r.importance for r in fitted.importances(spark).collect()}
    assert set(shares) == set(config.columns) and sum(shares.values()) == pytest.approx(1.0)
    got = [(r.step, r.prediction) for r in forecast_saved(stored, path).orderBy("step").collect()]
    want = forecast_from_bundle(stored, fitted, loaded, config).orderBy("step").collect()
    assert got == [(r.step, r.prediction) for r in want] and len(got) == 7
    old = str(tmp_path / "old")
    save_bundle(spark, fitted, loaded, old)
    with pytest.raises(FileNotFoundError, match="inputs"):
        load_config(spark, old, loaded)
