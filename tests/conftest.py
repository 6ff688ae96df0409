import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from nimbora.session import local_session

    scratch = str(tmp_path_factory.mktemp("scratch"))
    session = local_session("4", shuffle_partitions=4, spark__checkpoint__dir=scratch)
    yield session
    session.stop()


@pytest.fixture
def records(spark):
    """Build stored-layout records from dicts of raw fields; a missing key is absent."""
    from nimbora.sources.records import from_fields

    def build(rows):
        listed = [(i, row) for i, row in enumerate(rows)]
        objects = spark.createDataFrame(listed, "arrival bigint, fields map<string,string>")
        return from_fields(objects)

    return build


@pytest.fixture
def series(spark):
    """Clean series (idema, date, precipitation, average_humidity) from {station: {day: (p, h)}}."""

    def build(stations):
        rows = [
            (s, date(2020, 1, 1) + timedelta(days=d), float(p), float(h))
            for s, days in stations.items()
            for d, (p, h) in days.items()
        ]
        return spark.createDataFrame(
            rows, "idema string, date date, precipitation double, average_humidity double"
        )

    return build


def raw(fecha, **fields):
    return {"fecha": fecha, "indicativo": "1082", **fields}


def daily(start, days, **fields):
    first = date.fromisoformat(start)
    base = {"prec": "1,0", "hrMedia": "70", **fields}
    return [raw((first + timedelta(days=i)).isoformat(), **base) for i in range(days)]


@pytest.fixture(scope="session")
def make():
    class Make:
        raw = staticmethod(raw)
        daily = staticmethod(daily)

    return Make
