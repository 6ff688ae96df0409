"""Tree ensembles in the flat layout: boosting, walking, and cross-validation with them."""

from datetime import date, timedelta
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.operators.bulk import feature_table
from nimbora.operators.folds import cutoff_grid
from nimbora.operators.learners import _fit, fit_boosted_trees
from nimbora.operators.recursion import transform_path
from nimbora.operators.specs import FeatureConfig, Spec
from nimbora.operators.trees import Ensemble, TreeParams, boost, ensemble_columns, expanding_trees, mllib_ensemble, tree_sum
from nimbora.plans.benchmark import boosted_trees, run_benchmark
from nimbora.plans.predict import forecast_states, predict_dates, run_forecast
from test_features import random_days
from test_forecast import START, brute_asof

P, H = "precipitation", "average_humidity"
CONFIG = FeatureConfig("small", (Spec(P, "lag", 14), Spec(H, "lag", 14), Spec(P, "std", 5)))
FEW = TreeParams(rounds=12, rate=0.3)


def walk(e: Ensemble, rows, depth):
    """Plain Python: the margin of each row."""
    inner, bottom = 2**depth - 1, 2**depth
    out = []
    for x in np.atleast_2d(rows):
        total = e.base
        for t in range(len(e.leaves) // bottom):
            k = 1
            for _ in range(depth):
                k = 2 * k + int(x[e.splits[t * inner + k - 1]] > e.thresholds[t * inner + k - 1])
            total += e.leaves[t * bottom + k - bottom]
        out.append(total)
    return np.array(out)


def rain(n, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=(n, 3)), rng.integers(0, 4, n)])
    mean = np.exp(0.3 + 0.9 * (x[:, 0] > 0.2) + 0.5 * x[:, 3])
    return x, np.where(rng.random(n) < 0.3, 0.0, rng.gamma(2.0, mean / 1.4)), mean


@pytest.mark.parametrize("power", [1.9, 1.5, None])
def test_boosting_learns_and_repeats(power):
    x, y, mean = rain(3000, 1)
    params = TreeParams(power=power)
    fitted, again = boost(x[:2000], y[:2000], params), boost(x[:2000], y[:2000], params)
    margin = walk(fitted, x[2000:], params.depth)
    predicted = margin if power is None else np.exp(margin)
    assert np.corrcoef(predicted, mean[2000:])[0, 1] > 0.8
    error, flat = np.square(predicted - mean[2000:]).mean(), np.square(y[:2000].mean() - mean[2000:]).mean()
    assert error < 0.4 * flat
    assert fitted.importances.sum() == pytest.approx(1.0) and fitted.importances[[0, 3]].sum() > 0.6
    for name in ("splits", "thresholds", "leaves"):
        np.testing.assert_array_equal(getattr(fitted, name), getattr(again, name))


def test_first_tree_against_every_split_by_hand():
    """Squared loss, one round of depth 1: the split of largest gain among all places."""
    x, y, _ = rain(300, 2)
    params = TreeParams(rounds=1, rate=1.0, depth=1, row_share=1.0, column_share=1.0, power=None, bins=1000)
    e = boost(x, y, params)
    g = y.mean() - y

    def score(part):
        return part.sum() ** 2 / (len(part) + 1.0)

    gains = {
        (c, t): score(g[x[:, c] <= t]) + score(g[x[:, c] > t])
        for c in range(4) for t in np.unique(x[:, c])[:-1]
        if 2 <= (x[:, c] <= t).sum() <= len(y) - 2
    }
    best = max(gains, key=gains.get)
    assert (e.splits[0], e.thresholds[0]) == best
    right = x[:, best[0]] > best[1]
    np.testing.assert_allclose(e.leaves, [-g[~right].sum() / ((~right).sum() + 1), -g[right].sum() / (right.sum() + 1)])


@pytest.mark.parametrize("y", [np.zeros(40), np.full(40, 2.5), np.array([3.0])])
def test_constant_targets_give_their_value(y):
    e = boost(np.ones((len(y), 2)), y, FEW)
    np.testing.assert_allclose(np.exp(walk(e, [[1.0, 1.0], [-5.0, 9.0]], FEW.depth)), max(y[0], 0), atol=1e-4, rtol=0.01)
    assert not e.importances.any()


def test_walking_columns_equals_walking_in_python(spark):
    x, y, _ = rain(400, 3)
    e = boost(x, y, FEW)
    rows = spark.createDataFrame(x[:50].tolist(), "a double, b double, c double, d double")
    total = tree_sum([F.col(c) for c in "abcd"], *ensemble_columns(e).values(), FEW.depth)
    np.testing.assert_allclose([r.t for r in rows.select(total.alias("t")).collect()], walk(e, x[:50], FEW.depth), atol=1e-12)
    bare = Ensemble(1.5, *(np.array([]) for _ in range(4)))
    nothing = tree_sum([F.col("a")], *ensemble_columns(bare).values(), 4)
    assert rows.select(nothing.alias("t")).first().t == 1.5


def test_mllib_trees_in_one_expression_equal_their_transform(spark, series):
    rows = series({"a": random_days(300, 0.8, 6), "b": random_days(300, 0.7, 8)})
    fitted = fit_boosted_trees(feature_table(rows, CONFIG), CONFIG, maxIter=15)
    assert len(mllib_ensemble(spark, fitted.model).leaves) == 15 * 16
    for day in (60, 150, 299):
        cutoff = START + timedelta(days=day)
        stepped = transform_path(forecast_states(rows, CONFIG, cutoff), CONFIG, CONFIG.inputs, fitted.model)
        want = {r.idema: r.path for r in stepped.collect()}
        got = run_forecast(rows, fitted, CONFIG, cutoff)
        found = {k: [] for k in want}
        for r in got.orderBy("step").collect():
            found[r.idema].append(r.prediction)
        for k, path in want.items():
            np.testing.assert_allclose(found[k], path, atol=1e-9)


def loop_forecast(days, table, cutoff, params):
    """One fold: fit on the rows up to the cutoff, then day by day."""
    train = table[table.date <= cutoff].sort_values("date")
    e = boost(train[CONFIG.columns].to_numpy(float), train[P].to_numpy(float), params)
    k = (cutoff - START).days
    kept = {(d - START).days for d in table.date}
    target = {d: days[d][0] for d in kept if d <= k}
    humidity = {d: days[d][1] for d in kept if d <= k}
    path = []
    for step in range(1, CONFIG.horizon + 1):
        x = [brute_asof(target if s.column == P else humidity, k + step, s) for s in CONFIG.specs]
        x.append((cutoff + timedelta(days=step)).timetuple().tm_yday)
        path.append(float(np.exp(walk(e, x, params.depth)[0])))
        target[k + step] = path[-1]
    return len(train), path, e.importances


@pytest.mark.parametrize("fits_per_task", [1, 2, 50])
def test_trees_of_every_fold_against_a_loop(spark, series, fits_per_task):
    stations = {"a": random_days(400, 0.9, 21), "b": random_days(260, 0.7, 22)}
    rows = series(stations)
    cutoffs = [START + timedelta(days=d) for d in (5, 60, 120, 200, 320, 399)]
    first_days = [c + timedelta(days=1) for c in cutoffs]
    got = predict_dates(rows, first_days, CONFIG, boosted_trees(FEW, fits_per_task)).collect()
    fits = expanding_trees(feature_table(rows, CONFIG, warmup=0), cutoff_grid(spark, cutoffs), [CONFIG], FEW, fits_per_task=fits_per_task)
    trained = {(r.idema, r.cutoff): r for r in fits.select("idema", "cutoff", "n_train", "importances").collect()}
    table = feature_table(rows, CONFIG).toPandas()
    compared = 0
    for station, days in stations.items():
        own = table[table.idema == station]
        for cutoff in cutoffs:
            path = [r.prediction for r in sorted(got, key=lambda r: r.step) if (r.idema, r.cutoff) == (station, cutoff)]
            if not (own.date <= cutoff).any():
                assert not path and (station, cutoff) not in trained
                continue
            n, want, importances = loop_forecast(days, own, cutoff, FEW)
            np.testing.assert_allclose(path, want, rtol=1e-9)
            assert trained[station, cutoff].n_train == n
            np.testing.assert_allclose(trained[station, cutoff].importances, importances)
            compared += 1
    assert compared == 10


def test_benchmark_with_trees(spark, series):
    """Two configs; the report has scores, importances and spreads as with any learner."""
    configs = [CONFIG, FeatureConfig("lag", (Spec(P, "lag", 14),))]
    rows = series({"a": random_days(420, 0.95, 23)})
    report = run_benchmark(rows, configs, [2020], year_min_day=100, year_max_day=200, learner=boosted_trees(FEW))
    folds = report.folds.collect()
    assert {(r.config_id, r.n) for r in folds} >= {("small", 14), ("lag", 13)} or len(folds) == 16
    shares = report.importance.groupBy("config_id").agg(F.sum("importance").alias("s")).collect()
    assert [r.s for r in shares] == pytest.approx([1.0, 1.0])
    assert report.leaderboard.count() == 2 and report.residual_spread.count() == 28


class _Held:
    """Stands in for an estimator: how the rows that a fit iterates over are dealt, and the rows."""

    def fit(self, rows):
        return rows.rdd.getNumPartitions(), sorted((tuple(r.features), r.label) for r in rows.collect())


def test_fit_deals_rows_by_their_number_not_by_the_shuffle(spark):
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(40)]
    config = FeatureConfig("rain", (Spec(P, "lag", 14),))
    rows = spark.createDataFrame(
        [("A", d, float(i % 7), i + 1) for i, d in enumerate(days)], "idema string, date date, precipitation double, row_index int"
    )
    table = feature_table(rows, config)
    narrow, held = _fit(_Held(), table.coalesce(1), config)
    wide, same = _fit(_Held(), table.repartition(16), config)
    assert narrow == wide == 1 and held == same
    assert len(held) == table.count() > 0
