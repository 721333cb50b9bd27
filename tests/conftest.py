from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from ridelens.schema import TRIP_COLUMNS, TRIP_SCHEMA  # noqa: E402
from ridelens.session import build_session  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"

_DEFAULT = dict(
    duration=600,
    startTime=dt.datetime(2018, 6, 1, 8, 0, 0),
    endTime=dt.datetime(2018, 6, 1, 8, 10, 0),
    startStationID="1",
    startStationName="A",
    startStationLat=40.75,
    startStationLong=-73.99,
    endStationID="2",
    endStationName="B",
    endStationLat=40.76,
    endStationLong=-73.98,
    bikeID=1,
    userType="Subscriber",
    birthYear=1980,
    gender=1,
)


def trip(**overrides) -> tuple:
    row = dict(_DEFAULT)
    row.update(overrides)
    return tuple(row[c] for c in TRIP_COLUMNS)


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", app_name="ridelens-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_trips(spark):
    def make(rows: list[tuple]):
        return spark.createDataFrame(rows, TRIP_SCHEMA)

    return make


@pytest.fixture(scope="session")
def trips_small(spark):
    from ridelens.sources.tables import trips_from_tables

    return trips_from_tables(spark, SF0001)


@pytest.fixture(scope="session")
def cohort_small(trips_small):
    from ridelens.operators.cohort import clean_cohort

    return clean_cohort(trips_small)
