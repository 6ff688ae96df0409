"""Train-and-forecast for cutoffs, and forecasts from a saved model."""

from collections.abc import Callable, Iterable
from datetime import date, timedelta
from inspect import signature

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.constants import DATE, HORIZON, KEY, SEED
from nimbora.operators.blocks import ROW_INDEX
from nimbora.operators.bulk import feature_table, indexed
from nimbora.operators.clean import clean_daily
from nimbora.operators.folds import (
    FOLD,
    cutoff_grid,
    dense_history,
    fold_windows,
    observed_values,
)
from nimbora.operators.learners import FittedModel, fit_boosted_trees
from nimbora.operators.metrics import default_spread, forecast_bands, window_metrics
from nimbora.operators.recursion import as_predictions, transform_path, tree_path
from nimbora.operators.specs import DEFAULT_CONFIG, LOOKBACK_DAYS, FeatureConfig
from nimbora.operators.trees import ensemble_columns, mllib_ensemble
from nimbora.plans.benchmark import LEAST_SQUARES, FoldLearner, fold_forecasts, union_features
from nimbora.session import materialize
from nimbora.sources.bundle import Manifest, load_bundle, load_config, save_bundle

Learner = Callable[[DataFrame, FeatureConfig], FittedModel]


def inference_data_window(
    max_date: date, horizon: int = HORIZON, lookback_days: int = LOOKBACK_DAYS
) -> tuple[date, date]:
    """First and last day to load to forecast after `max_date` and to score the forecast."""
    return max_date - timedelta(days=lookback_days), max_date + timedelta(days=horizon)


def forecast_states(series: DataFrame, config: FeatureConfig, cutoff: date) -> DataFrame:
    """One state row per station that has training rows at the cutoff.

    Columns: idema, fold_id, cutoff, observed, and one array per input column. `series`
    is clean; its first `config.warmup` rows per station are no history (they are missing
    from a feature table as well).
    """
    grid = cutoff_grid(series.sparkSession, [cutoff])
    rows = indexed(series).filter(F.col(ROW_INDEX) > config.warmup)
    lookback = max(1, config.warmup)
    windows = fold_windows(rows, grid, config.inputs, lookback, config.horizon)
    trained = rows.filter(F.col(DATE) <= F.lit(cutoff)).select(KEY).distinct()
    state = trained.join(windows, KEY, "left")
    arrays = dense_history(config.inputs, lookback, config.warmup)
    return state.select(
        KEY,
        F.lit(1).alias(FOLD),
        F.lit(cutoff).alias("cutoff"),
        observed_values(config.warmup).alias("observed"),
        *[a.alias(c) for c, a in arrays.items()],
    )


def run_forecast(
    series: DataFrame, fitted: FittedModel, config: FeatureConfig, cutoff: date
) -> DataFrame:
    """Recursive forecast of every station with one fitted model, paired with actuals.

    Tree ensembles are walked inside one expression; other models take a transform a step.
    """
    if fitted.feature_columns != config.columns:
        raise ValueError("the model was fitted on other features than the config names")
    state = forecast_states(series, config, cutoff)
    if not isinstance(fitted.model, GBTRegressionModel):
        return as_predictions(transform_path(state, config, config.inputs, fitted.model))
    model = ensemble_columns(mllib_ensemble(series.sparkSession, fitted.model))
    arrays = {c: F.col(c) for c in config.inputs}
    path = tree_path(config, arrays, F.col("cutoff"), model, fitted.model.getMaxDepth())
    carried = [c for c in state.columns if c not in config.inputs]
    return as_predictions(state.select(*carried, path.alias("path")))


def fit_at(
    series: DataFrame,
    config: FeatureConfig,
    cutoff: date,
    learner: Learner = fit_boosted_trees,
    min_date: date | None = None,
) -> FittedModel:
    """Fit on the feature rows of [min_date, cutoff]; one model for all stations given."""
    train = feature_table(series, config).filter(F.col(DATE) <= F.lit(cutoff))
    if min_date is not None:
        train = train.filter(F.col(DATE) >= F.lit(min_date))
    return learner(train, config)


def run_prediction(
    series: DataFrame,
    cutoff: date,
    config: FeatureConfig = DEFAULT_CONFIG,
    learner: Learner = fit_boosted_trees,
) -> DataFrame:
    """Fit at the cutoff, then forecast. The series, which both read, is worked out once."""
    series = materialize(series, "series")
    return run_forecast(series, fit_at(series, config, cutoff, learner), config, cutoff)


def predict_dates(
    series: DataFrame,
    first_days: Iterable[date],
    config: FeatureConfig = DEFAULT_CONFIG,
    learner: FoldLearner = LEAST_SQUARES,
) -> DataFrame:
    """Forecasts starting on each given day, refitted for each station and day in one job."""
    rows = indexed(series)
    grid = cutoff_grid(series.sparkSession, [d - timedelta(days=1) for d in first_days])
    fits = learner.fit(union_features(rows, [config]), grid, [config])
    return fold_forecasts(rows, fits, grid, [config], learner=learner)


def predict_dates_with(
    series: DataFrame,
    first_days: Iterable[date],
    learner: Learner,
    config: FeatureConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Like `predict_dates` with an MLlib learner: one distributed fit per day.

    The number of fits is the number of requested days, not a function of the data.
    """
    cutoffs = [d - timedelta(days=1) for d in first_days]
    forecasts = [run_prediction(series, c, config, learner) for c in cutoffs]
    together = forecasts[0]
    for forecast in forecasts[1:]:
        together = together.unionByName(forecast)
    return together


def export_model(
    series: DataFrame,
    path: str,
    prediction_date: date | None = None,
    config: FeatureConfig = DEFAULT_CONFIG,
    learner: Learner = fit_boosted_trees,
    seed: int = SEED,
) -> Manifest:
    """Fit on everything before `prediction_date`, or on all rows, and save a bundle."""
    table = feature_table(series, config)
    bounds = table.agg(F.min(DATE).alias("first"), F.max(DATE).alias("last")).first()
    cutoff = bounds.last if prediction_date is None else prediction_date - timedelta(days=1)
    seeded = {"seed": seed} if "seed" in signature(learner).parameters else {}
    fitted = learner(table.filter(F.col(DATE) <= F.lit(cutoff)), config, **seeded)
    manifest = Manifest(
        model_name=fitted.name,
        seed=seed,
        min_date=bounds.first,
        max_date=cutoff,
        forecast_horizon=config.horizon,
        feature_columns=fitted.feature_columns,
        additional_date_features=list(config.calendar),
    )
    save_bundle(series.sparkSession, fitted, manifest, path, config)
    return manifest


def forecast_from_bundle(
    records: DataFrame, fitted: FittedModel, manifest: Manifest, config: FeatureConfig
) -> DataFrame:
    """Forecast from a saved model: only the trailing window of records is used.

    The window is cleaned by itself, so its fill values are those of the window.
    """
    lookback = 2 * config.warmup + 1
    first, last = inference_data_window(manifest.max_date, manifest.forecast_horizon, lookback)
    window = records.filter(F.col("fecha").between(first.isoformat(), last.isoformat()))
    series = clean_daily(window, row_index=True, columns=config.inputs)
    return run_forecast(series, fitted, config, manifest.max_date)


def forecast_saved(records: DataFrame, path: str) -> DataFrame:
    """Forecast from nothing but the records and the bundle at `path`."""
    spark = records.sparkSession
    fitted, manifest = load_bundle(spark, path)
    return forecast_from_bundle(records, fitted, manifest, load_config(spark, path, manifest))


def report(predictions: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Metrics record per station and cutoff; a forecast without actuals has none."""
    return window_metrics(predictions, horizon)


def chart_table(predictions: DataFrame, spread: DataFrame | None = None) -> DataFrame:
    """Forecast rows with band and levels, as the charts show them. `spread` is that of a
    benchmark of the same model; without it the default band is used."""
    if spread is None:
        spread = default_spread(predictions.sparkSession)
    return forecast_bands(predictions, spread)

