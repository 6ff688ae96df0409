"""Feature-set search: a seeded table of random configs, benchmarked together."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.constants import BASE_COLUMNS, HORIZON, SEED
from nimbora.operators.metrics import best_share
from nimbora.operators.specs import KINDS, FeatureConfig, Spec
from nimbora.plans.benchmark import BenchmarkReport, run_benchmark

# What a random config may be made of.
COLUMNS_PER_CONFIG = (2, 5)
KINDS_PER_COLUMN = (1, 2)
WINDOW_CHOICES = ((14, 16, 18, 20), (14,))


def random_config_table(spark: SparkSession, count: int, seed: int = SEED) -> DataFrame:
    """(config_id, specs) of `count` random configs; the same seed gives the same table.

    Each takes 2 to 5 base columns, 1 or 2 kinds for each, and one of two window lists
    for each kind. All draws are hashes of seed, config and choice, so rows are
    independent of each other and of the partitioning.
    """

    def draw(*parts):
        return F.xxhash64(F.lit(seed), F.col("id"), *parts)

    def between(bounds: tuple[int, int], *parts):
        low, high = bounds
        return (F.pmod(draw(*parts), F.lit(high - low + 1)) + low).cast("int")

    def shuffled(values: Sequence[str], *parts):
        tagged = F.transform(
            F.array(*[F.lit(v) for v in values]),
            lambda v: F.struct(draw(*parts, v).alias("h"), v.alias("v")),
        )
        return F.transform(F.array_sort(tagged), lambda e: e["v"])

    def windows(column, kind):
        many, one = (F.array(*[F.lit(w) for w in c]) for c in WINDOW_CHOICES)
        coin = F.pmod(draw(F.lit("windows"), column, kind), F.lit(2))
        return F.when(coin == 0, many).otherwise(one)

    def specs_of(column):
        some = F.slice(
            shuffled(KINDS, F.lit("kind"), column),
            F.lit(1),
            between(KINDS_PER_COLUMN, F.lit("kinds"), column),
        )
        return F.flatten(
            F.transform(
                some,
                lambda kind: F.transform(
                    windows(column, kind),
                    lambda w: F.struct(column.alias("column"), kind.alias("kind"), w.alias("window")),
                ),
            )
        )

    chosen = F.slice(
        shuffled(BASE_COLUMNS, F.lit("column")),
        F.lit(1),
        between(COLUMNS_PER_CONFIG, F.lit("columns")),
    )
    return spark.range(count).select(
        F.format_string("random_%03d", "id").alias("config_id"),
        F.flatten(F.transform(chosen, specs_of)).alias("specs"),
    )


def read_configs(table: DataFrame) -> list[FeatureConfig]:
    """Config table to config values; a config drives the plan, so it lives on the driver."""
    return [
        FeatureConfig(
            r.config_id, tuple(Spec(s.column, s.kind, s.window) for s in r.specs), horizon=HORIZON
        )
        for r in table.orderBy("config_id").collect()
    ]


def exploration_configs(
    spark: SparkSession,
    initial: Sequence[FeatureConfig],
    iterations: int,
    seed: int = SEED,
) -> list[FeatureConfig]:
    """The given configs, then `iterations` random ones."""
    if iterations <= 0:
        return list(initial)
    return [*initial, *read_configs(random_config_table(spark, iterations, seed))]


def explore_configs(
    series: DataFrame,
    initial: Sequence[FeatureConfig] = (),
    iterations: int = 0,
    years: Sequence[int] = (2024,),
    training_min_date: date | None = None,
    year_min_day: int | None = None,
    year_max_day: int | None = None,
    share: float = 0.2,
    seed: int = SEED,
    keep: bool = False,
) -> tuple[BenchmarkReport, DataFrame]:
    """Benchmark all configs; returns the report and the best share of the leaderboard.

    Without random configs the whole leaderboard is returned. `keep` as in `run_benchmark`.
    """
    configs = exploration_configs(series.sparkSession, initial, iterations, seed)
    result = run_benchmark(
        series, configs, years, training_min_date, year_min_day, year_max_day, keep
    )
    kept = share if iterations > 0 else 1.0
    return result, best_share(result.leaderboard, len(configs), kept)
