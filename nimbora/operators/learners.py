"""Learners: least squares for every cutoff in one pass, and MLlib regressors.

Expanding-window least squares never copies training rows. Rows become sums of products per
(station, cutoff interval), for the columns of all configs together; adding those up in cutoff
order gives the normal equations of every fold, and each config takes its part of them.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.constants import DATE, KEY, SEED, TARGET
from nimbora.operators.blocks import ROW_INDEX
from nimbora.operators.specs import FeatureConfig
from nimbora.session import dealt_by, materialize

_EPOCH = date(1970, 1, 1)

#: Up to so many columns, [1, inputs, target], their products are summed by generated code. Cutoffs
#: whose running sums are held at a time.
JVM_COLUMNS, SCAN_CUTOFFS = 16, 256
#: Rows in a partition of what a distributed fit iterates over.
FIT_ROWS = 50_000
FIT_SCHEMA = (
    f"{KEY} string, config_id string, cutoff date, n_train long, "
    "intercept double, coefficients array<double>, importances array<double>"
)


def _cutoff_list(grid: DataFrame) -> list[date]:
    """Distinct cutoffs, ascending. A grid is configuration: years x folds per year."""
    return [r.cutoff for r in grid.select("cutoff").distinct().orderBy("cutoff").collect()]


def _jvm_sums(rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """(idema, bucket, stage, sums): pairwise products of [1, inputs, target], upper triangle by
    rows, added up inside Spark's own aggregation, map-side first."""
    values = [F.lit(1.0), *[F.col(n) for n in inputs], F.col(TARGET).cast("double")]
    products = [F.sum(a * b) for i, a in enumerate(values) for b in values[i:]]
    return rows.groupBy(KEY, "bucket", "stage").agg(F.array(*products).alias("sums"))


def _arrow_sums(rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """As `_jvm_sums`, for more products than one generated aggregation can hold."""
    columns, names = [*inputs, TARGET], [KEY, "bucket", "stage", "sums"]
    triangle = np.triu_indices(len(columns) + 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, part in batch.groupby(names[:3], sort=False):
                z = np.column_stack([np.ones(len(part)), part[columns].to_numpy(float)])
                out.append((*group, (z.T @ z)[triangle]))
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(sums, f"{KEY} string, bucket int, stage int, sums array<double>")


def cutoff_buckets(features: DataFrame, edges: np.ndarray) -> DataFrame:
    """Adds `bucket`, the first cutoff (by its place in `edges`, days since 1970) that a row's day
    does not exceed. The days between the cutoffs are configuration, like the cutoffs, and so
    is what is broadcast: a row for each."""
    days = np.arange(edges[0], edges[-1] + 1)
    table = pd.DataFrame({"_day": days, "bucket": np.searchsorted(edges, days, side="left")}).astype("int32")
    known = F.broadcast(features.sparkSession.createDataFrame(table, "_day int, bucket int"))
    rows = features.filter(F.unix_date(DATE) <= int(edges[-1]))
    met = rows.join(known, F.unix_date(DATE) == F.col("_day"), "left")
    return met.select(*features.columns, F.coalesce("bucket", F.lit(0)).alias("bucket"))


def _solve(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares from cumulated cross products; dependent inputs get the smallest fit."""
    n = moments[:, 0, 0]
    mean = moments[:, 0, 1:] / n[:, None]
    centred = moments[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    variance = np.einsum("kii->ki", centred)
    flat = variance <= 1e-12 * np.maximum(1.0, mean**2)
    sd = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, variance)))
    corr = centred / (sd[:, :, None] * sd[:, None, :])
    corr[flat] = 0.0
    np.swapaxes(corr, 1, 2)[flat] = 0.0
    inputs, target = corr[:, :-1, :-1], corr[:, :-1, -1:]
    beta = (np.linalg.pinv(inputs, rcond=1e-10, hermitian=True) @ target)[:, :, 0]
    coefficients = beta * sd[:, -1:] / sd[:, :-1]
    intercept = mean[:, -1] - np.einsum("kp,kp->k", coefficients, mean[:, :-1])
    weight = np.abs(beta)
    total = weight.sum(axis=1, keepdims=True)
    importance = np.divide(weight, total, out=np.zeros_like(weight), where=total > 0)
    return intercept, coefficients, importance


def _scan(rows: pd.DataFrame, edges: np.ndarray, size: int, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, running sums) of a station's cutoffs in blocks: cutoffs x stages x products.
    Stage k of the running sums holds the rows beyond the first k + 1 warm-ups."""
    stages = int(rows["stage"].max()) + 1
    bucket, stage = rows["bucket"].to_numpy(), rows["stage"].to_numpy()
    order = np.argsort(bucket, kind="stable")
    total = np.zeros((stages, size))
    for first in range(0, len(edges), block):
        steps = np.zeros((min(block, len(edges) - first), stages, size))
        low, high = np.searchsorted(bucket[order], [first, first + len(steps)])
        here = order[low:high]
        if len(here):
            sums = np.stack(rows["sums"].iloc[here].to_numpy())
            np.add.at(steps, (bucket[here] - first, stage[here]), sums)
        steps[0] += total
        running = np.cumsum(steps, axis=0)
        total = running[-1]
        yield first, np.cumsum(running[:, ::-1], axis=1)[:, ::-1]


def _fit_station(rows: pd.DataFrame, edges: np.ndarray, plans, width: int, block: int) -> pd.DataFrame:
    """All configs and cutoffs of a station. A config takes its own part of the products."""
    upper = np.triu_indices(width)
    place = np.zeros((width, width), dtype=int)
    place[upper] = np.arange(len(upper[0]))
    place = np.maximum(place, place.T)
    out = []
    for first, running in _scan(rows, edges, len(upper[0]), block):
        for config_id, stage, at in plans:
            if stage >= running.shape[1]:
                continue
            moments = running[:, stage][:, place[np.ix_(at, at)]]
            trained = moments[:, 0, 0] > 0.5
            if not trained.any():
                continue
            intercept, coefficients, importance = _solve(moments[trained])
            days = edges[first : first + len(moments)][trained]
            out.append(
                pd.DataFrame(
                    {
                        KEY: rows[KEY].iloc[0],
                        "config_id": config_id,
                        "cutoff": [date.fromordinal(_EPOCH.toordinal() + int(d)) for d in days],
                        "n_train": moments[trained, 0, 0].round().astype("int64"),
                        "intercept": intercept,
                        "coefficients": list(coefficients),
                        "importances": list(importance),
                    }
                )
            )
    return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in FIT_SCHEMA.split(", ")])


def expanding_least_squares(
    features: DataFrame, grid: DataFrame, configs: Sequence[FeatureConfig], block: int = SCAN_CUTOFFS
) -> DataFrame:
    """One fit per (station, config, cutoff) on all feature rows up to the cutoff.

    `features` holds the columns of all configs; each config drops its own warm-up.
    Rows: idema, config_id, cutoff, n_train, intercept, coefficients, importances, the
    arrays in `config.columns` order. Cutoffs without a training row give none.

    The products of all columns in use are added up once per (station, cutoff interval, warm-up
    stage), whatever the number of configs, and scanned over the intervals `block` cutoffs at a time.
    """
    edges = np.array([(d - _EPOCH).days for d in _cutoff_list(grid)])
    inputs = list(dict.fromkeys(n for c in configs for n in c.columns if n != TARGET))
    names = [None, *inputs, TARGET]
    warmups = sorted({c.warmup for c in configs})
    plans = [
        (c.config_id, warmups.index(c.warmup), [0, *(names.index(n) for n in c.columns), len(names) - 1])
        for c in configs
    ]
    passed = sum((F.col(ROW_INDEX) > w).cast("int") for w in warmups) - 1
    rows = cutoff_buckets(features, edges).select(
        KEY, "bucket", passed.alias("stage"), TARGET, *[F.col(n).cast("double").alias(n) for n in inputs]
    )
    add_up = _jvm_sums if len(names) <= JVM_COLUMNS else _arrow_sums
    sums = add_up(rows.filter("stage >= 0"), inputs)
    return dealt_by(sums, KEY).groupBy(KEY).applyInPandas(
        lambda pdf: _fit_station(pdf, edges, plans, len(names), block), FIT_SCHEMA
    )


def importance_rows(fits: DataFrame, configs: Sequence[FeatureConfig]) -> DataFrame:
    """(idema, config_id, cutoff, feature, importance) of every fit."""
    names = F.create_map(
        *[
            x
            for c in configs
            for x in (F.lit(c.config_id), F.array(*[F.lit(n) for n in c.columns]))
        ]
    )
    pairs = F.arrays_zip(
        F.element_at(names, F.col("config_id")).alias("feature"),
        F.col("importances").alias("importance"),
    )
    return fits.select(KEY, "config_id", "cutoff", F.inline(pairs))


@dataclass(frozen=True)
class FittedModel:
    """An MLlib regression model with the names of its inputs, in order."""

    name: str
    model: object
    feature_columns: list[str]
    extra: dict = field(default_factory=dict)

    def importances(self, spark) -> DataFrame:
        """(feature, importance), largest first; for a linear model |standardised weights|."""
        if hasattr(self.model, "featureImportances"):
            weights = self.model.featureImportances.toArray()
        else:
            spread = np.array(self.extra["input_sd"])
            weights = np.abs(self.model.coefficients.toArray()) * spread
            weights = weights / (weights.sum() or 1.0)
        rows = [(n, float(w)) for n, w in zip(self.feature_columns, weights)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature"
        )


def _fit_rows(train: DataFrame, config: FeatureConfig) -> DataFrame:
    """(features, label) for a fit of many small jobs, written once: a job then walks no lineage but
    that of a stored table. Dealt by the number of rows, not by the width of the shuffle they come
    from, and ordered by station and day, so what is sampled does not depend on the cluster."""
    assembler = VectorAssembler(inputCols=config.columns, outputCol="features")
    assembled = assembler.transform(train).select(KEY, DATE, "features", F.col(TARGET).alias("label"))
    stored = materialize(assembled, "training")
    parts = max(1, -(-stored.count() // FIT_ROWS))
    ordered = stored.repartitionByRange(parts, KEY, DATE).sortWithinPartitions(KEY, DATE)
    return ordered.select("features", "label")


def _fit(estimator, train: DataFrame, config: FeatureConfig):
    """Fit on assembled rows; they are held while the estimator iterates over them."""
    rows = _fit_rows(train, config)
    rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(rows)
    finally:
        rows.unpersist()


# Rounds, learning rate, depth, row share, column share, rows per leaf.
TREE_DEFAULTS = {
    "maxIter": 300,
    "stepSize": 0.05,
    "maxDepth": 4,
    "subsamplingRate": 0.9,
    "featureSubsetStrategy": "0.7",
    "minInstancesPerNode": 2,
}
TWEEDIE_POWER = 1.9


def fit_boosted_trees(
    train: DataFrame, config: FeatureConfig, seed: int = SEED, **params
) -> FittedModel:
    """MLlib boosted trees on the feature rows in `train`, one station's or many pooled.

    Squared loss: MLlib trees have no Tweedie objective. `fit_tweedie` has it.
    """
    trees = GBTRegressor(**{**TREE_DEFAULTS, "seed": seed, **params})
    return FittedModel("BoostedTrees", _fit(trees, train, config), config.columns)


def fit_tweedie(train: DataFrame, config: FeatureConfig, **params) -> FittedModel:
    """Generalised linear model with Tweedie variance and log link."""
    glm = GeneralizedLinearRegression(
        **{
            "family": "tweedie",
            "variancePower": TWEEDIE_POWER,
            "linkPower": 0.0,
            "regParam": 1e-3,
            **params,
        }
    )
    model = _fit(glm, train, config)
    (sd,) = train.agg(
        F.array(*[F.coalesce(F.stddev_samp(c), F.lit(0.0)) for c in config.columns]).alias("sd")
    ).collect()
    return FittedModel("TweedieGlm", model, config.columns, {"input_sd": list(sd.sd)})
