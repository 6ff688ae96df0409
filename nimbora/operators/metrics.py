"""Scoring: fold metrics, benchmark summaries, bands, leaderboards.

Predictions are rows (config_id, idema, fold_id, year, cutoff, step, date, prediction,
actual); `actual` is NULL past the last observed test row.
"""

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbora.constants import DATE, KEY, STEP_SPREAD_MM
from nimbora.functions.scoring import mean_absolute_error, non_negative, rain_error, severity
from nimbora.operators.folds import FOLD

FOLD_KEYS = ("config_id", KEY, "year", FOLD, "cutoff")


def pair_by_position(
    forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str] = (KEY, FOLD)
) -> DataFrame:
    """Forecast step n with the n-th actual row by date; unmatched steps drop out."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(DATE)).alias("step")
    numbered = actuals.select(*keys, nth, F.col("actual"))
    return forecasts.join(numbered, [*keys, "step"])


def pair_by_date(
    forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str] = (KEY, FOLD)
) -> DataFrame:
    """The option: forecast and actual of the same day, whatever days are missing."""
    return forecasts.join(actuals.select(*keys, DATE, "actual"), [*keys, DATE])


def fold_metrics(predictions: DataFrame, keys: Sequence[str] = FOLD_KEYS) -> DataFrame:
    """(keys, n, mae, rain_error) of every fold with at least one actual."""
    actual, predicted = F.col("actual"), F.col("prediction")
    scored = predictions.filter(actual.isNotNull())
    return scored.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n"),
        mean_absolute_error(actual, predicted).alias("mae"),
        rain_error(actual, predicted).alias("rain_error"),
    )


def window_metrics(predictions: DataFrame, horizon: int) -> DataFrame:
    """Metrics record per station and cutoff; the period is the full horizon."""
    scored = fold_metrics(predictions, (KEY, "cutoff"))
    return scored.select(
        KEY,
        F.col("rain_error").alias("custom_rain_error"),
        F.col("mae").alias("mae_error"),
        F.date_add("cutoff", 1).alias("period_start"),
        F.date_add("cutoff", horizon).alias("period_end"),
    )


def yearly_mae(folds: DataFrame, keys: Sequence[str] = ("config_id", KEY)) -> DataFrame:
    """Mean MAE of each year's folds, with what the overall rain error needs."""
    return folds.groupBy(*keys, "year").agg(
        F.avg("mae").alias("mae"),
        F.sum("rain_error").alias("rain_error_sum"),
        F.count("*").alias("folds"),
    )


def cv_summary(folds: DataFrame, keys: Sequence[str] = ("config_id", KEY)) -> DataFrame:
    """Mean and population std of yearly MAE, and mean rain error over all folds."""
    overall = yearly_mae(folds, keys).groupBy(*keys).agg(
        F.avg("mae").alias("mae"),
        F.stddev_pop("mae").alias("mae_std"),
        (F.sum("rain_error_sum") / F.sum("folds")).alias("rain_error"),
    )
    return overall.select(
        *keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mae", "mae_std", "rain_error")]
    )


def residuals(predictions: DataFrame) -> DataFrame:
    """actual - prediction by step."""
    return predictions.filter(F.col("actual").isNotNull()).withColumn(
        "residual", F.col("actual") - F.col("prediction")
    )


def residual_spread(
    predictions: DataFrame, keys: Sequence[str] = ("config_id", KEY)
) -> DataFrame:
    """Population std of the residuals of each step; 0 where a step has none."""
    spread = F.stddev_pop(F.col("actual") - F.col("prediction"))
    return predictions.groupBy(*keys, "step").agg(F.coalesce(spread, F.lit(0.0)).alias("sd"))


def default_spread(spark: SparkSession) -> DataFrame:
    """The fixed (step, sd) table."""
    rows = list(enumerate(STEP_SPREAD_MM, start=1))
    return spark.createDataFrame(rows, "step int, sd double")


def forecast_bands(predictions: DataFrame, spread: DataFrame) -> DataFrame:
    """Add the one-sigma band in mm, clipped at 0 below, and everything as levels.

    `spread` has one row per step of the horizon, for all forecasts or for each of the keys
    config_id and station that it holds; only the former, one row per step, is broadcast.
    """
    keys = [c for c in ("config_id", KEY, "step") if c in spread.columns]
    table = spread.select(*keys, "sd")
    banded = predictions.join(table if len(keys) > 1 else F.broadcast(table), keys)
    lower = non_negative(F.col("prediction") - F.col("sd"))
    upper = F.col("prediction") + F.col("sd")
    return banded.select(
        *predictions.columns,
        lower.alias("lower_band"),
        upper.alias("upper_band"),
        severity(F.col("prediction")).alias("level"),
        severity(lower).alias("lower_level"),
        severity(upper).alias("upper_level"),
    )


def mean_importance(importances: DataFrame, keys: Sequence[str] = ("config_id", KEY)) -> DataFrame:
    """(keys, feature, importance): mean over folds, largest first within each key."""
    return (
        importances.groupBy(*keys, "feature")
        .agg(F.avg("importance").alias("importance"))
        .orderBy(*keys, F.desc("importance"), "feature")
    )


def leaderboard(summary: DataFrame, station: str | None = KEY) -> DataFrame:
    """Rank configs by mean MAE ascending, per station."""
    groups = [station] if station else []
    order = Window.partitionBy(*groups).orderBy("mae", "config_id")
    return summary.withColumn("rank", F.row_number().over(order))


def best_share(ranked: DataFrame, configs: int, share: float = 0.2) -> DataFrame:
    """Keep the best ceil(configs * share) of a leaderboard; a top-k report."""
    return ranked.filter(F.col("rank") <= ceil(configs * share))
