"""Registered queries run the whole job: full rounds, all years."""

import os

import pytest

import bench
from catalog import queries as q
from nimbora.operators import learners

SF_DIR = os.environ.get("NIMBORA_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables absent")


def test_tree_queries_ask_for_full_rounds(spark, monkeypatch):
    asked, fit = [], learners._fit

    def short(estimator, train, config):
        asked.append(estimator.getMaxIter())
        return fit(estimator.copy({estimator.maxIter: 2}), train, config)

    monkeypatch.setattr(learners, "_fit", short)
    for name in ("gbt_predictions", "feature_importance", "bundle_roundtrip"):
        q.QUERIES[name](spark, SF_DIR)
    assert asked == [300] * 3


def test_predictions_are_returned(spark, monkeypatch):
    fit = learners._fit
    monkeypatch.setattr(learners, "_fit", lambda e, t, c: fit(e.copy({e.maxIter: 2}), t, c))
    for name in ("gbt_predictions", "tweedie_predictions"):
        rows = q.QUERIES[name](spark, SF_DIR).collect()
        assert len({r["prediction"] for r in rows}) > 1


def test_benchmarks_score_every_year(spark, monkeypatch):
    asked, run = [], q.run_benchmark

    def noted(series, configs, years, **more):
        asked.append(list(years))
        return run(series, configs, asked[-1], **more)

    monkeypatch.setattr(q, "run_benchmark", noted)
    monkeypatch.setattr(bench, "run_benchmark", noted)
    monkeypatch.setattr(q, "explore_configs", lambda series, *a, years: asked.append(list(years)) or (None, None))
    for query in (q.default_benchmark, q.config_search, bench.network_benchmark):
        query(spark, SF_DIR)
    assert asked == [list(range(1995, 2002))] * 3


def test_forecasts_are_of_every_year_under_either_name(spark):
    key = lambda r: (r["idema"], r["date"], r["step"])
    plain, every = (
        {key(r): r["prediction"] for r in q.QUERIES[n](spark, SF_DIR).collect()}
        for n in ("expanding_ols_forecast", "expanding_ols_forecast_all")
    )
    assert set(plain) == set(every) and all(abs(every[k] - plain[k]) < 2e-5 for k in plain)
    assert {1995, 2001} <= {d.year for _, d, _ in plain}
