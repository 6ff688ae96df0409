"""Registered queries against their SQL on the smallest driver tables.

All of them run with NIMBORA_ALL_QUERIES=1; otherwise a quick selection does.
"""

import os
from pathlib import Path

import pytest
from compare import connect, difference

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("NIMBORA_SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "upsert_latest clean_daily feature_table network_seasonality asof_roll_all trailing_window "
    "backfill_tiles fold_scores cv_summary recursive_linear_forecast expanding_ols_forecast "
    "manifest_validate"
).split()
TEXTS = entry_module.oracle_sql()
NAMES = sorted(TEXTS) if os.environ.get("NIMBORA_ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_text_belongs_to_a_query():
    assert set(TEXTS) <= set(entry_module.queries())


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["idema", "day_of_year", "week_sum"] and frame.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, duck, name):
    assert difference(entry_module.queries()[name](spark, SF_DIR), duck, TEXTS[name]) is None
