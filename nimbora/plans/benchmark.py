"""Expanding-window cross-validation: configs x stations x folds as one job."""

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.constants import BENCHMARK_YEARS, DATE, KEY
from nimbora.functions.arrays import let
from nimbora.functions.calendar import calendar_columns
from nimbora.operators.bulk import bulk_features, indexed
from nimbora.operators.folds import (
    FOLD,
    dense_history,
    fold_grid,
    fold_windows,
    observed_values,
    year_list,
)
from nimbora.operators.learners import expanding_least_squares, importance_rows
from nimbora.operators.metrics import (
    cv_summary,
    fold_metrics,
    leaderboard,
    mean_importance,
    residual_spread,
)
from nimbora.operators.recursion import as_predictions, linear_path, tree_path
from nimbora.operators.specs import FeatureConfig, base_columns, distinct_specs
from nimbora.operators.trees import MODEL_FIELDS, TreeParams, expanding_trees
from nimbora.session import materialize
from nimbora.sources.sinks import write_table


@dataclass(frozen=True)
class BenchmarkReport:
    """Lazy result tables of one benchmark, keyed by config and station."""

    predictions: DataFrame
    folds: DataFrame
    summary: DataFrame
    residual_spread: DataFrame
    importance: DataFrame
    leaderboard: DataFrame

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Leaderboard, residual spread and importances as Parquet below `path`."""
        write_table(self.leaderboard, f"{path}/leaderboard", mode)
        write_table(self.residual_spread, f"{path}/residual_spread", mode)
        write_table(self.importance, f"{path}/importance", mode)


@dataclass(frozen=True)
class FoldLearner:
    """How every fold is fitted, and how a fit, a struct of `fields`, forecasts.

    `fit(features, grid, configs)` gives one row per (idema, config_id, cutoff) with the fields and
    `importances`; `path(config, arrays, cutoff, fit)` is the array of clipped predictions.
    """

    fit: Callable[[DataFrame, DataFrame, Sequence[FeatureConfig]], DataFrame]
    fields: tuple[str, ...]
    path: Callable[[FeatureConfig, dict[str, Column], Column, Column], Column]


LEAST_SQUARES = FoldLearner(
    expanding_least_squares,
    ("intercept", "coefficients"),
    lambda config, arrays, cutoff, fit: linear_path(config, arrays, cutoff, fit["intercept"], fit["coefficients"]),
)


def boosted_trees(params: TreeParams = TreeParams(), fits_per_task: int = 4) -> FoldLearner:
    """Boosted trees refitted at every cutoff, Tweedie loss by default."""

    def path(config, arrays, cutoff, fit):
        model = {f: fit[f] for f in MODEL_FIELDS}
        return tree_path(config, arrays, cutoff, model, params.depth, exponentiate=params.power is not None)

    def fit(features, grid, configs):
        return expanding_trees(features, grid, configs, params, fits_per_task=fits_per_task)

    return FoldLearner(fit, MODEL_FIELDS, path)


def union_features(series: DataFrame, configs: Sequence[FeatureConfig]) -> DataFrame:
    """Features of all configs computed once, warm-up rows still in."""
    calendar = list(dict.fromkeys(c for config in configs for c in config.calendar))
    rows = bulk_features(series, distinct_specs(configs))
    return rows.select("*", *calendar_columns(calendar, F.col(DATE)))


def fold_forecasts(
    series: DataFrame,
    fits: DataFrame,
    grid: DataFrame,
    configs: Sequence[FeatureConfig],
    training_min_date: date | None = None,
    learner: FoldLearner = LEAST_SQUARES,
) -> DataFrame:
    """Predictions of every fitted fold, paired with the rows that came after it."""
    inputs = base_columns(distinct_specs(configs))
    horizon = max(c.horizon for c in configs)
    lookback = max(1, max(c.warmup for c in configs))
    windows = fold_windows(series, grid, inputs, lookback, horizon)
    if training_min_date is not None:
        # Days before the training period are no history for the recursion.
        first = F.datediff(F.lit(training_min_date), F.col("cutoff"))
        windows = windows.join(F.broadcast(grid.select(FOLD, "cutoff")), FOLD).select(
            KEY,
            FOLD,
            F.filter("history", lambda e: e["offset"] >= first).alias("history"),
            "observed",
        )
    fit = F.struct(*learner.fields)
    by_config = F.map_from_entries(F.collect_list(F.struct("config_id", fit.alias("fit"))))
    folds = fits.groupBy(KEY, "cutoff").agg(by_config.alias("fits")).join(
        F.broadcast(grid), "cutoff"
    )
    state = folds.join(windows, [KEY, FOLD], "left")
    candidates = [_candidate(c, lookback, learner) for c in configs]
    paths = state.select(
        KEY, FOLD, "year", "cutoff", F.inline(F.array_compact(F.array(*candidates)))
    )
    return as_predictions(paths)


def _candidate(config: FeatureConfig, lookback: int, learner: FoldLearner) -> Column:
    """(config_id, path, observed) of one config over a state row, NULL if it has no fit."""
    fit = F.try_element_at("fits", F.lit(config.config_id))
    arrays = dense_history(base_columns(config.specs), lookback, config.warmup)
    seen = F.slice(observed_values(config.warmup), 1, config.horizon)

    def forecast(found: Column) -> Column:
        path = learner.path(config, arrays, F.col("cutoff"), found)
        candidate = F.struct(
            F.lit(config.config_id).alias("config_id"),
            path.alias("path"),
            seen.alias("observed"),
        )
        return F.when(found.isNotNull(), candidate)

    return let(fit, forecast)


def run_benchmark(
    series: DataFrame,
    configs: Sequence[FeatureConfig],
    years: Iterable[int] = range(BENCHMARK_YEARS[0], BENCHMARK_YEARS[1] + 1),
    training_min_date: date | None = None,
    year_min_day: int | None = None,
    year_max_day: int | None = None,
    keep: bool = False,
    learner: FoldLearner = LEAST_SQUARES,
) -> BenchmarkReport:
    """Refit per cutoff, forecast, score and summarise each config on each station.

    Refits of the default learner, least squares, share one pass over the data; those of
    `boosted_trees()` are dealt out by station and run of cutoffs. Configs of one call must
    agree on the horizon, because the fold grid steps by it. `keep` writes fits and predictions
    to shared storage, so that reading several of the result tables does the work once.
    """
    if len({c.horizon for c in configs}) != 1:
        raise ValueError("configs of one benchmark must share the forecast horizon")
    if len({c.config_id for c in configs}) != len(configs):
        raise ValueError("config ids must be distinct")
    rows = indexed(series)
    spark = series.sparkSession
    grid = fold_grid(year_list(spark, years), configs[0].horizon, year_min_day, year_max_day)
    features = union_features(rows, configs)
    if training_min_date is not None:
        features = features.filter(F.col(DATE) >= F.lit(training_min_date))
    fits = learner.fit(features, grid, configs)
    if keep:
        fits = materialize(fits, "fits")
    predictions = fold_forecasts(rows, fits, grid, configs, training_min_date, learner)
    if keep:
        predictions = materialize(predictions, "predictions")
    folds = fold_metrics(predictions)
    summary = cv_summary(folds)
    return BenchmarkReport(
        predictions=predictions,
        folds=folds,
        summary=summary,
        residual_spread=residual_spread(predictions),
        importance=mean_importance(importance_rows(fits, configs)),
        leaderboard=leaderboard(summary),
    )


