"""Spark side: one callable per query, each over whole tables."""

from collections.abc import Callable
from datetime import date, timedelta
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.constants import (
    BASE_COLUMNS,
    DATE,
    DAY,
    KEY,
    METRIC_FIELDS,
    TARGET,
    WIND_DIRECTION,
)
from nimbora.functions.calendar import CALENDAR, calendar_columns
from nimbora.functions.scoring import severity
from nimbora.operators import metrics
from nimbora.operators.asof import asof_features, features_at
from nimbora.operators.blocks import ROW_INDEX
from nimbora.operators.bulk import bulk_features, feature_table, short_stations
from nimbora.operators.clean import (
    clean_daily,
    parse_records,
    raw_fields,
    station_means,
    unreadable_readings,
)
from nimbora.operators.folds import (
    FOLD,
    dense_history,
    fold_grid,
    fold_windows,
    observed_values,
    test_rows,
    years_of,
)
from nimbora.operators.learners import fit_boosted_trees, fit_tweedie
from nimbora.operators.recursion import as_predictions, linear_path
from nimbora.operators.seasonality import seasonality
from nimbora.operators.specs import (
    DEFAULT_CONFIG,
    DEFAULT_SPECS,
    KINDS,
    LAG,
    STATS,
    FeatureConfig,
    Spec,
)
from nimbora.operators.split import (
    chart_days,
    context_slice,
    days_around,
    resolve_cutoffs,
    train_test_split,
)
from nimbora.operators.upsert import keyed, latest_records, upsert_counts
from nimbora.plans.benchmark import boosted_trees, run_benchmark
from nimbora.plans.predict import (
    chart_table,
    export_model,
    fit_at,
    forecast_saved,
    predict_dates,
    run_prediction,
)
from nimbora.plans.search import explore_configs
from nimbora.session import materialize, scratch_path
from nimbora.sources.adapter import daily_series, region_records, supplier_records
from nimbora.sources.bundle import check_manifests
from nimbora.sources.records import to_json_text
from nimbora.sources.shards import read_lines, read_shards, read_shards_tolerant
from nimbora.sources.sinks import write_json_lines
from nimbora.sources.store import RecordStore, inference_window, trailing_window
from nimbora.sources.tiles import backfill_tiles
from nimbora.streaming.ingest import stream_upsert

HORIZON = 14
ROUND_SHIFT = 1.37e-8

# Coefficients of the fixed linear model: intercept, then one per input.
FIXED_CONFIG = FeatureConfig(
    "fixed", (Spec(TARGET, LAG, 14), Spec(TARGET, "mean", 3), Spec(TARGET, "std", 5))
)
FIXED_WEIGHTS = (1.5, 0.25, 0.5, -0.125, 0.0078125)

# Two inputs, so that the normal equations have a short closed form.
SMALL_CONFIG = FeatureConfig("small", (Spec(TARGET, LAG, 14),))

# Every kind, on the target and on another column.
ASOF_SPECS = tuple(Spec(c, k, 9) for c in (TARGET, "average_humidity") for k in KINDS)


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round for comparison. Engines add in different orders, so an exact half could go
    either way; the shift moves halves to values no mean or sum of readings takes."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(ROUND_SHIFT), places) for c in columns})


def _regions(spark: SparkSession, sf_dir: str, columns=(TARGET,)) -> DataFrame:
    return daily_series(region_records(spark, sf_dir), columns)


def _suppliers(spark: SparkSession, sf_dir: str, columns=(TARGET,)) -> DataFrame:
    return daily_series(supplier_records(spark, sf_dir), columns)


# --- ingest -----------------------------------------------------------------


def upsert_latest(spark, sf_dir):
    latest = latest_records(region_records(spark, sf_dir))
    return latest.select(KEY, DAY, *METRIC_FIELDS)


def network_upsert(spark, sf_dir):
    return latest_records(supplier_records(spark, sf_dir), columns=METRIC_FIELDS)


def upsert_counts_by_source(spark, sf_dir):
    records = region_records(spark, sf_dir).withColumn("path", F.substring(DAY, 1, 4))
    return upsert_counts(records).withColumn("records", F.col("records").cast("int"))


def store_upsert(spark, sf_dir):
    """Two upserts into a Parquet store: records up to a day, then all others."""
    records = region_records(spark, sf_dir)
    store = RecordStore(spark, scratch_path(spark, "store"), buckets=4)
    store.upsert(records.filter(F.col("arrival") % 2 == 0))
    store.upsert(records.filter(F.col("arrival") % 2 == 1))
    return store.read().select(KEY, DAY, *METRIC_FIELDS)


def station_range_scan(spark, sf_dir):
    """Range scan of every station from a store."""
    store = RecordStore(spark, scratch_path(spark, "store"), buckets=4)
    store.upsert(region_records(spark, sf_dir))
    stations = [r.idema for r in store.zones().select(KEY).distinct().orderBy(KEY).collect()]
    scans = [store.station_range(s, date(1996, 3, 1), date(2000, 2, 29)) for s in stations]
    together = scans[0]
    for scan in scans[1:]:
        together = together.unionByName(scan)
    return together.select(KEY, DAY, *METRIC_FIELDS)


def line_import(spark, sf_dir):
    """JSON lines written by the sink, read back and upserted."""
    path = scratch_path(spark, "lines")
    records = region_records(spark, sf_dir)
    ordered = records.repartitionByRange(8, "arrival").sortWithinPartitions("arrival")
    write_json_lines(ordered, path)
    return latest_records(read_lines(spark, path)).select(KEY, DAY, *METRIC_FIELDS)


def _write_array_shards(records: DataFrame, path: str) -> None:
    """One array file per (station, year) of upserted records: at most 366 objects each."""
    year = F.substring(DAY, 1, 4).alias("year")
    text = records.select(KEY, year, F.struct(DAY, to_json_text(records).alias("json")).alias("o"))
    objects = F.transform(F.sort_array(F.collect_list("o")), lambda o: o["json"])
    shard = F.concat(F.lit("[\n"), F.array_join(objects, ",\n"), F.lit("\n]"))
    shards = text.groupBy(KEY, "year").agg(shard.alias("value"))
    shards.withColumnRenamed(KEY, "station").write.partitionBy("station", "year").text(path)


def shard_import(spark, sf_dir):
    """Array shards with absent keys, read recursively and cleaned."""
    path = scratch_path(spark, "shards")
    latest = latest_records(region_records(spark, sf_dir))
    _write_array_shards(latest.drop("rest"), path)
    shards = read_shards(spark, path, pattern="*.txt")
    series = clean_daily(latest_records(shards))
    return _rounded(series, *[c for c in BASE_COLUMNS if c != WIND_DIRECTION])


def import_counts(spark, sf_dir):
    """Rows per imported shard file, named by its folders."""
    path = scratch_path(spark, "shards")
    _write_array_shards(latest_records(region_records(spark, sf_dir)), path)
    loaded = read_shards_tolerant(spark, path, pattern="*.txt").records
    counts = upsert_counts(loaded)
    folder = F.regexp_extract("path", r"station=(\w+)/year=(\d+)", 0)
    return counts.select(folder.alias("shard"), F.col("records").cast("int"))


def tolerant_import(spark, sf_dir):
    """Records of each shard, or why it is rejected, of shards spoiled by their year: cut off,
    wrapped in an object, or with an element that is no record."""
    path, spoiled = scratch_path(spark, "shards"), scratch_path(spark, "spoiled")
    _write_array_shards(latest_records(region_records(spark, sf_dir)), path)
    whole = spark.read.text(path, wholetext=True).select("station", "year", "value")
    fault = F.col("year").cast("int") % 4
    value = (
        F.when(fault == 1, F.regexp_replace("value", r"\]\s*$", ""))
        .when(fault == 2, F.concat(F.lit('{"records": '), "value", F.lit("}")))
        .when(fault == 3, F.regexp_replace("value", r"^\s*\[", '[7, "text", null, '))
        .otherwise(F.col("value"))
    )
    whole.withColumn("value", value).write.partitionBy("station", "year").text(spoiled)
    loaded = read_shards_tolerant(spark, spoiled, pattern="*.txt")
    counts = upsert_counts(loaded.records).select("path", F.col("records").cast("int"), F.lit(None).cast("string").alias("error"))
    rejected = loaded.rejected.select("path", F.lit(0).alias("records"), "error")
    folder = F.regexp_extract("path", r"station=(\w+)/year=(\d+)", 0)
    return counts.unionByName(rejected).select(folder.alias("shard"), "records", "error")


def stream_ingest(spark, sf_dir):
    """JSON lines landing in a folder, upserted by the stream."""
    landing = scratch_path(spark, "landing")
    records = region_records(spark, sf_dir)
    ordered = records.repartitionByRange(8, "arrival").sortWithinPartitions("arrival")
    write_json_lines(ordered, landing)
    store = RecordStore(spark, scratch_path(spark, "store"), buckets=4)
    stream_upsert(spark, landing, store, scratch_path(spark, "progress")).awaitTermination()
    return store.read().select(KEY, DAY, *METRIC_FIELDS)


def quarantine(spark, sf_dir):
    """Readings spoiled on purpose, listed with their text."""
    latest = latest_records(region_records(spark, sf_dir))
    spoiled = latest.withColumn(
        "hrMedia", F.when(F.col("hrMedia") == "77", F.lit("77%")).otherwise(F.col("hrMedia"))
    )
    return unreadable_readings(spoiled)


# --- cleaning ---------------------------------------------------------------


def clean_table(spark, sf_dir):
    series = _regions(spark, sf_dir, BASE_COLUMNS).drop(ROW_INDEX)
    return _rounded(series, *[c for c in BASE_COLUMNS if c != WIND_DIRECTION])


def impute_mean(spark, sf_dir):
    return _rounded(station_means(latest_records(region_records(spark, sf_dir))), *BASE_COLUMNS)


def wind_sector(spark, sf_dir):
    """Sector of every raw wind text, before filling."""
    latest = latest_records(supplier_records(spark, sf_dir), columns=raw_fields([WIND_DIRECTION]))
    parsed = parse_records(latest, columns=[WIND_DIRECTION])
    return parsed.select(KEY, DATE, F.col(WIND_DIRECTION).cast("int").alias("sector"))


def calendar_features(spark, sf_dir):
    series = _regions(spark, sf_dir)
    return series.select(KEY, DATE, *calendar_columns(list(CALENDAR), F.col(DATE)))


# --- row-based features -----------------------------------------------------


def _bulk(spark, sf_dir, specs, columns=(TARGET,)):
    rows = bulk_features(_regions(spark, sf_dir, columns), specs)
    names = [s.name for s in specs]
    return _rounded(rows.select(KEY, DATE, *names), *names)


def bulk_lag(spark, sf_dir):
    return _bulk(spark, sf_dir, [Spec(TARGET, LAG, n) for n in (1, 14, 20)])


def bulk_roll(kind, spark, sf_dir):
    specs = [Spec(TARGET, kind, 14), Spec("average_humidity", kind, 25)]
    return _bulk(spark, sf_dir, specs, (TARGET, "average_humidity"))


def leak_free_roll(spark, sf_dir):
    rows = bulk_features(_regions(spark, sf_dir), [Spec(TARGET, "std", 14)], leak_free=True)
    name = Spec(TARGET, "std", 14).name
    return _rounded(rows.select(KEY, DATE, name), name)


def _feature_rows(series, config):
    rows = feature_table(series, config)
    return _rounded(
        rows.select(KEY, DATE, *config.inputs, *config.columns),
        *config.inputs,
        *[s.name for s in config.specs],
    )


def features_default(spark, sf_dir):
    series = _regions(spark, sf_dir, DEFAULT_CONFIG.inputs)
    return _feature_rows(series, DEFAULT_CONFIG)


def network_features(spark, sf_dir):
    series = _suppliers(spark, sf_dir, DEFAULT_CONFIG.inputs)
    return _feature_rows(series, DEFAULT_CONFIG)


def short_series(spark, sf_dir):
    """Stations with no more rows than a warm-up of 440 days."""
    stations = short_stations(_suppliers(spark, sf_dir), 440)
    return stations.withColumn("rows", F.col("rows").cast("int"))


def seasonality_7d(spark, sf_dir):
    profile = seasonality(_regions(spark, sf_dir))
    return _rounded(profile, "week_sum")


def network_seasonality(spark, sf_dir):
    return _rounded(seasonality(_suppliers(spark, sf_dir)), "week_sum")


# --- scans and splits -------------------------------------------------------


def trailing(spark, sf_dir):
    """Whether a record is in the window depends on its station and day alone, and these are the key
    of the upsert: only the window's records need it."""
    window = trailing_window(keyed(supplier_records(spark, sf_dir)), 51)
    return latest_records(window, columns=["prec", "hrMedia"])


def store_trailing(spark, sf_dir):
    """The same window from a store, whose zones name the folders to read."""
    store = RecordStore(spark, scratch_path(spark, "store"), buckets=4)
    store.upsert(supplier_records(spark, sf_dir))
    return store.trailing_window(51).select(KEY, DAY, "prec", "hrMedia")


def _year_end_cutoffs(series: DataFrame) -> DataFrame:
    return series.groupBy(KEY, F.year(DATE).alias("y")).agg(F.max(DATE).alias("cutoff")).drop("y")


def inference(spark, sf_dir):
    """[cutoff - 51, cutoff + 14] around each station's last day of every year."""
    latest = latest_records(region_records(spark, sf_dir), columns=["prec"])
    cutoffs = _year_end_cutoffs(latest.withColumn(DATE, F.to_date(DAY)))
    return inference_window(latest, cutoffs, 51, HORIZON).select(KEY, "cutoff", DAY, "prec")


def tiles(spark, sf_dir):
    """Half-year tiles from every supplier's first to last day."""
    latest = supplier_records(spark, sf_dir).groupBy(KEY)
    requests = latest.agg(
        F.to_date(F.min(DAY)).alias("start"), F.to_date(F.max(DAY)).alias("end")
    )
    return backfill_tiles(requests)


def cutoffs_resolved(spark, sf_dir):
    return resolve_cutoffs(_suppliers(spark, sf_dir))


def train_test_counts(spark, sf_dir):
    series = _suppliers(spark, sf_dir)
    train, test = train_test_split(series, date(1995, 6, 1), date(1999, 6, 30), HORIZON)
    tagged = train.select(KEY, F.lit(1).alias("train"), F.lit(0).alias("test")).unionByName(
        test.select(KEY, F.lit(0).alias("train"), F.lit(1).alias("test"))
    )
    return tagged.groupBy(KEY).agg(
        F.sum("train").cast("int").alias("train"), F.sum("test").cast("int").alias("test")
    )


# --- date-based features ----------------------------------------------------


def _asof(spark, sf_dir, specs, columns=(TARGET,), source=_regions):
    rows = asof_features(source(spark, sf_dir, columns), specs)
    names = [s.name for s in specs]
    return _rounded(rows.select(KEY, DATE, *names), *names)


def asof_lag(spark, sf_dir):
    return _asof(spark, sf_dir, [Spec(TARGET, LAG, n) for n in (1, 14, 20)])


def asof_roll_std(spark, sf_dir):
    return _asof(spark, sf_dir, [Spec(TARGET, "std", n) for n in (3, 14)])


def asof_roll_all(spark, sf_dir):
    return _asof(spark, sf_dir, ASOF_SPECS, (TARGET, "average_humidity"))


def network_asof(spark, sf_dir):
    return _asof(spark, sf_dir, DEFAULT_SPECS, DEFAULT_CONFIG.inputs, _suppliers)


def future_features(spark, sf_dir):
    """Feature rows of the 14 days after each station's last day."""
    series = materialize(_suppliers(spark, sf_dir, DEFAULT_CONFIG.inputs), "series")
    ahead = days_around(resolve_cutoffs(series), -1, HORIZON).select(KEY, DATE)
    rows = features_at(ahead, series, DEFAULT_SPECS, ["day_of_year", "quarter"])
    return _rounded(rows, *[s.name for s in DEFAULT_SPECS])


# --- folds and scoring ------------------------------------------------------


def _grid(series: DataFrame) -> DataFrame:
    return fold_grid(years_of(series), HORIZON)


def fold_rows(spark, sf_dir):
    """Test rows per station and fold of the grid over all years of the data."""
    series = _regions(spark, sf_dir)
    grid = _grid(series)
    counted = test_rows(series, grid, HORIZON).groupBy(KEY, FOLD).agg(
        F.count("*").cast("int").alias("n")
    )
    return counted.join(grid, FOLD).select(KEY, FOLD, "year", "start_day", "cutoff", "n")


def _standin(series: DataFrame, lags=(14,), by_date: bool = False) -> DataFrame:
    """Predictions of naive learners, one per lag: the value exactly `lag` days before.

    The series is read several times, so it is written out once, as a clean table would be.
    """
    series = materialize(series, "series")
    grid = _grid(series)
    actual = test_rows(series, grid, HORIZON).select(
        KEY, FOLD, DATE, F.col(TARGET).alias("actual")
    )
    config = F.format_string("lag_%d", "lag").alias("config_id")
    lag = F.explode(F.array(*[F.lit(n) for n in lags])).alias("lag")
    folds = actual.select(KEY, FOLD).distinct().join(grid, FOLD)
    ahead = days_around(folds.select("*", lag), -1, HORIZON).select("*", config)
    past = series.select(KEY, DATE, F.col(TARGET).alias("past"), lag).select(
        KEY, config, F.date_add(DATE, F.col("lag")).alias(DATE), "past"
    )
    pair = metrics.pair_by_date if by_date else metrics.pair_by_position
    # Paired before the values are looked up: most steps of a sparse station meet no actual.
    steps = ahead.withColumnRenamed("offset", "step")
    return pair(steps, actual).join(past, [KEY, "config_id", DATE], "left").select(
        "config_id",
        KEY,
        FOLD,
        "year",
        "cutoff",
        "step",
        DATE,
        F.coalesce("past", F.lit(0.0)).alias("prediction"),
        "actual",
    )


def fold_scores(spark, sf_dir):
    scored = metrics.fold_metrics(_standin(_regions(spark, sf_dir)), (KEY, FOLD))
    return _rounded(scored, "mae", "rain_error")


def network_fold_scores(spark, sf_dir):
    scored = metrics.fold_metrics(_standin(_suppliers(spark, sf_dir)), (KEY, FOLD))
    return _rounded(scored, "mae", "rain_error")


def fold_scores_by_date(spark, sf_dir):
    pairs = _standin(_regions(spark, sf_dir), by_date=True)
    return _rounded(metrics.fold_metrics(pairs, (KEY, FOLD)), "mae", "rain_error")


def window_report(spark, sf_dir):
    report = metrics.window_metrics(_standin(_regions(spark, sf_dir)), HORIZON)
    return _rounded(report, "custom_rain_error", "mae_error")


def cv_summary(spark, sf_dir):
    folds = metrics.fold_metrics(_standin(_regions(spark, sf_dir)))
    return _rounded(metrics.cv_summary(folds), "mae", "mae_std", "rain_error")


def residual_rows(spark, sf_dir):
    rows = metrics.residuals(_standin(_suppliers(spark, sf_dir)))
    return _rounded(rows.select(KEY, FOLD, "step", "residual"), "residual")


def residual_spread(spark, sf_dir):
    spread = metrics.residual_spread(_standin(_regions(spark, sf_dir)))
    return _rounded(spread, "sd")


def forecast_band(spark, sf_dir):
    predictions = _standin(_regions(spark, sf_dir))
    banded = metrics.forecast_bands(predictions, metrics.default_spread(spark))
    shown = banded.select(
        KEY, FOLD, "step", "prediction", "lower_band", "upper_band",
        "level", "lower_level", "upper_level",
    )
    return _rounded(shown, "prediction", "lower_band", "upper_band")


def severity_levels(spark, sf_dir):
    series = _suppliers(spark, sf_dir)
    return series.groupBy(KEY, severity(F.col(TARGET)).alias("level")).agg(
        F.count("*").cast("int").alias("days")
    )


def context(spark, sf_dir):
    series = _regions(spark, sf_dir)
    rows = context_slice(series, _year_end_cutoffs(series), HORIZON)
    return _rounded(rows.select(KEY, "cutoff", DATE, TARGET), TARGET)


def chart_dates(spark, sf_dir):
    series = _regions(spark, sf_dir)
    return chart_days(series, _year_end_cutoffs(series), HORIZON)


def leaderboard_topk(spark, sf_dir):
    """Four naive learners ranked per station, best 60% kept."""
    series = _regions(spark, sf_dir)
    lags = (14, 16, 18, 20)
    predictions = _standin(series, lags)
    ranked = metrics.leaderboard(metrics.cv_summary(metrics.fold_metrics(predictions)))
    return _rounded(metrics.best_share(ranked, len(lags), 0.6), "mae", "mae_std", "rain_error")


# --- forecasting ------------------------------------------------------------


def recursive_linear_forecast(spark, sf_dir):
    """Fixed linear model run recursively from every cutoff of the grid."""
    config = FIXED_CONFIG
    series = _regions(spark, sf_dir)
    grid = _grid(series)
    windows = fold_windows(series, grid, config.inputs, config.warmup, HORIZON)
    arrays = dense_history(config.inputs, config.warmup)
    weights = F.array(*[F.lit(w) for w in FIXED_WEIGHTS[1:]])
    path = linear_path(config, arrays, F.col("cutoff"), F.lit(FIXED_WEIGHTS[0]), weights)
    state = windows.join(grid.select(FOLD, "cutoff"), FOLD)
    paths = state.select(
        KEY, FOLD, "cutoff", path.alias("path"), observed_values().alias("observed")
    )
    return _rounded(as_predictions(paths), "prediction", "actual")


def all_years(records: DataFrame) -> list[int]:
    """Calendar years of stored records, ascending, from their day texts alone."""
    years = records.select(F.substring(F.trim(DAY), 1, 4).cast("int").alias("year")).distinct()
    return [r.year for r in years.orderBy("year").collect()]


def _small_benchmark(spark, sf_dir):
    """Every fold of all years."""
    records = region_records(spark, sf_dir)
    return run_benchmark(daily_series(records, (TARGET,)), [SMALL_CONFIG], all_years(records))


def expanding_ols_forecast(spark, sf_dir):
    predictions = _small_benchmark(spark, sf_dir).predictions
    return _rounded(
        predictions.select(KEY, FOLD, "step", DATE, "prediction", "actual"),
        "prediction",
        "actual",
        places=5,
    )


def ols_summary(spark, sf_dir):
    summary = _small_benchmark(spark, sf_dir).summary
    return _rounded(summary, "mae", "mae_std", "rain_error", places=5)


def ols_importance(spark, sf_dir):
    return _rounded(_small_benchmark(spark, sf_dir).importance, "importance")


def default_benchmark(spark, sf_dir):
    """The default feature set, all folds of all years, per station."""
    records = region_records(spark, sf_dir)
    series = daily_series(records, DEFAULT_CONFIG.inputs)
    return run_benchmark(series, [DEFAULT_CONFIG], all_years(records)).summary


def date_forecasts(spark, sf_dir):
    """Least-squares forecasts from two given first days, with bands and levels."""
    first_days = [date(1998, 3, 14), date(2000, 2, 26)]
    shown = chart_table(predict_dates(_regions(spark, sf_dir), first_days, SMALL_CONFIG))
    columns = ("prediction", "actual", "lower_band", "upper_band")
    kept = shown.select(KEY, "cutoff", "step", DATE, *columns, "level", "lower_level", "upper_level")
    return _rounded(kept, *columns, places=5)


def _pooled(spark, sf_dir):
    return _regions(spark, sf_dir, DEFAULT_CONFIG.inputs)


LAST_TRAINING_DAY = date(1999, 6, 30)


def _usable(forecasts: DataFrame) -> DataFrame:
    """Keys and actuals of forecasts and whether each is a number not below zero. What the
    iterative learners predict has no SQL form."""
    value = F.col("prediction")
    usable = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    kept = forecasts.select(KEY, "step", DATE, "actual", F.coalesce(usable, F.lit(False)).cast("int").alias("usable"))
    return _rounded(kept, "actual", places=5)


def gbt_predictions(spark, sf_dir):
    """Boosted trees fitted on all stations, forecasting each of them."""
    return run_prediction(_pooled(spark, sf_dir), LAST_TRAINING_DAY, learner=fit_boosted_trees)


def tweedie_predictions(spark, sf_dir):
    return run_prediction(_pooled(spark, sf_dir), LAST_TRAINING_DAY, learner=fit_tweedie)


def gbt_forecast(spark, sf_dir):
    """The part of `gbt_predictions` that SQL can express."""
    return _usable(gbt_predictions(spark, sf_dir))


def tweedie_forecast(spark, sf_dir):
    """The part of `tweedie_predictions` that SQL can express."""
    return _usable(tweedie_predictions(spark, sf_dir))


def feature_importance(spark, sf_dir):
    model = fit_at(_pooled(spark, sf_dir), DEFAULT_CONFIG, LAST_TRAINING_DAY, fit_boosted_trees)
    return model.importances(spark)


def bundle_roundtrip(spark, sf_dir):
    """Fit, save, load, and forecast from the trailing window of the stored records."""
    records = latest_records(
        region_records(spark, sf_dir), columns=raw_fields(DEFAULT_CONFIG.inputs)
    )
    series = clean_daily(records, row_index=True, columns=DEFAULT_CONFIG.inputs)
    path = scratch_path(spark, "bundle")
    export_model(series, path, LAST_TRAINING_DAY + timedelta(days=1), learner=fit_boosted_trees)
    return forecast_saved(records, path)


def _quarter_days(series: DataFrame) -> list[date]:
    """The first day of each quarter in which the series has rows."""
    quarters = series.select(F.to_date(F.date_trunc("quarter", F.col(DATE))).alias("day")).distinct()
    return [r.day for r in quarters.orderBy("day").collect()]


def tree_fold_predictions(spark, sf_dir):
    """Boosted trees with Tweedie loss, refitted for each station at the start of every quarter."""
    series = _pooled(spark, sf_dir)
    return predict_dates(series, _quarter_days(series), DEFAULT_CONFIG, boosted_trees())


def tree_fold_scores(spark, sf_dir):
    """Per station: folds, scored days, the error of the training mean, and whether the trees of
    `tree_fold_predictions` stay below 1.1 times that error."""
    series = materialize(_pooled(spark, sf_dir), "series")
    first_days = _quarter_days(series)
    predictions = predict_dates(series, first_days, DEFAULT_CONFIG, boosted_trees())
    table = feature_table(series, DEFAULT_CONFIG).select(KEY, DATE, TARGET)
    cutoffs = F.explode(F.array(*[F.lit(d - timedelta(days=1)) for d in first_days])).alias("cutoff")
    means = table.select(KEY, DATE, TARGET, cutoffs).filter(F.col(DATE) <= F.col("cutoff"))
    means = means.groupBy(KEY, "cutoff").agg(F.avg(TARGET).alias("mean"))
    scored = predictions.filter("actual is not null").join(means, [KEY, "cutoff"])
    error = lambda by: F.avg(F.abs(F.col("actual") - F.col(by)))
    station = scored.groupBy(KEY).agg(
        F.countDistinct("cutoff").cast("int").alias("folds"),
        F.count("*").cast("int").alias("days"),
        error("mean").alias("mean_error"),
        (error("prediction") <= 1.1 * error("mean")).cast("int").alias("sound"),
    )
    return _rounded(station, "mean_error")


def config_search(spark, sf_dir):
    """The default and three random feature sets over all years, best 20% per station."""
    records = region_records(spark, sf_dir)
    series = daily_series(records, BASE_COLUMNS)
    _, best = explore_configs(series, [DEFAULT_CONFIG], 3, years=all_years(records))
    return best


# --- manifests --------------------------------------------------------------


def _manifest_text(defect: Column) -> Column:
    """Manifest JSON of a customer, spoiled in one of nine ways."""

    def spoiled(case: int, bad: str, good: str) -> Column:
        return F.when(defect == case, F.lit(bad)).otherwise(F.lit(good))

    columns = '["precipitation_lag_14d", "day_of_year"]'
    body = [
        F.lit('{"version": '),
        F.when(defect == 1, F.lit("99")).when(defect == 2, F.lit('"1"')).otherwise(F.lit("1")),
        F.lit(', "model_name": '),
        spoiled(3, "7", '"BoostedTrees"'),
        F.lit(', "seed": '),
        spoiled(4, '"28"', "28"),
        F.lit(', "min_date": '),
        spoiled(5, "19491226", '"1949-12-26"'),
        F.lit(', "max_date": "2023-09-10", "forecast_horizon": '),
        spoiled(6, "14.5", "14"),
        F.lit(', "feature_columns": '),
        spoiled(7, '["a", 1]', columns),
        F.lit(', "additional_date_features": '),
        spoiled(8, "null", '["day_of_year"]'),
        F.lit("}"),
    ]
    return F.concat(*body)


def manifest_validate(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    manifests = customers.select("c_custkey", _manifest_text(F.col("c_custkey") % 9).alias("text"))
    checked = check_manifests(manifests)
    return checked.select("c_custkey", "error", "model_name", "seed", "forecast_horizon")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "upsert_latest": upsert_latest,
    "network_upsert": network_upsert,
    "upsert_counts": upsert_counts_by_source,
    "store_upsert": store_upsert,
    "station_range_scan": station_range_scan,
    "line_import": line_import,
    "shard_import": shard_import,
    "import_counts": import_counts,
    "tolerant_import": tolerant_import,
    "stream_upsert": stream_ingest,
    "unreadable_readings": quarantine,
    "clean_daily": clean_table,
    "impute_mean": impute_mean,
    "wind_sector": wind_sector,
    "calendar_features": calendar_features,
    "bulk_lag": bulk_lag,
    **{f"bulk_roll_{k}": partial(bulk_roll, k) for k in STATS},
    "leak_free_roll": leak_free_roll,
    "feature_table": features_default,
    "network_features": network_features,
    "short_series": short_series,
    "seasonality_7d": seasonality_7d,
    "network_seasonality": network_seasonality,
    "trailing_window": trailing,
    "store_trailing_window": store_trailing,
    "inference_window": inference,
    "backfill_tiles": tiles,
    "resolve_cutoffs": cutoffs_resolved,
    "train_test_counts": train_test_counts,
    "asof_lag": asof_lag,
    "asof_roll_std": asof_roll_std,
    "asof_roll_all": asof_roll_all,
    "network_asof": network_asof,
    "future_features": future_features,
    "fold_grid": fold_rows,
    "fold_scores": fold_scores,
    "network_fold_scores": network_fold_scores,
    "fold_scores_by_date": fold_scores_by_date,
    "window_report": window_report,
    "cv_summary": cv_summary,
    "residuals": residual_rows,
    "residual_spread": residual_spread,
    "forecast_band": forecast_band,
    "severity_levels": severity_levels,
    "context_slice": context,
    "chart_days": chart_dates,
    "leaderboard_topk": leaderboard_topk,
    "recursive_linear_forecast": recursive_linear_forecast,
    "expanding_ols_forecast": expanding_ols_forecast,
    "ols_summary": ols_summary,
    "ols_importance": ols_importance,
    "expanding_ols_forecast_all": expanding_ols_forecast,
    "ols_summary_all": ols_summary,
    "ols_importance_all": ols_importance,
    "default_benchmark": default_benchmark,
    "date_forecasts": date_forecasts,
    "gbt_forecast": gbt_forecast,
    "gbt_predictions": gbt_predictions,
    "tweedie_forecast": tweedie_forecast,
    "tweedie_predictions": tweedie_predictions,
    "feature_importance": feature_importance,
    "bundle_roundtrip": bundle_roundtrip,
    "tree_fold_predictions": tree_fold_predictions,
    "tree_fold_scores": tree_fold_scores,
    "config_search": config_search,
    "manifest_validate": manifest_validate,
}
