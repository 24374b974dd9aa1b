import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspark import build_session  # noqa: E402
from tallyspark.operators import clean, tables  # noqa: E402
from tallyspark.sources.schema import RAW_EVENTS  # noqa: E402

SMALL = os.environ.get("TALLY_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def raw_of(spark):
    """Raw events from (time, type, product, user, session[, price, brand, code]) tuples."""

    def build(rows):
        full = []
        for r in rows:
            time, kind, product, user, session, *rest = r
            price, brand, code = (list(rest) + [10.0, "acme", "toys.cars"][len(rest):])[:3]
            full.append((time, kind, product, 1, code, brand, price, user, session))
        return spark.createDataFrame(full, RAW_EVENTS)

    return build


@pytest.fixture(scope="session")
def events_of(raw_of):
    return lambda rows: clean.clean_events(raw_of(rows))


@pytest.fixture(scope="session")
def users_of(events_of):
    return lambda rows: tables.user_metrics(events_of(rows))


@pytest.fixture(scope="session")
def rows_of():
    """Collected rows as dicts, keyed by a column."""

    def collect(frame, key):
        return {r[key]: r.asDict() for r in frame.collect()}

    return collect


@pytest.fixture(scope="session")
def days_of(spark):
    """A user-day rollup from (user, date) pairs."""

    def build(pairs):
        rows = [(u, dt.date.fromisoformat(d), 1) for u, d in pairs]
        return spark.createDataFrame(rows, "user_id long, event_date date, n_events long")

    return build
