import datetime as dt
import os
import sys
import uuid

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from tidepanel.schema import DAILY_SCHEMA  # noqa: E402
from tidepanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def sales(sku="A", channel="c1", region="r1", start="2022-01-03", units=(20.0,), brand="b", segment="s", category="k",
          price=10.0, promo=0, stock=50.0):
    """One row per day from ``start``; ``units`` gives the length, ``promo`` may be a set of day offsets."""
    first = day(start)
    rows = []
    for i, u in enumerate(units):
        p = int(i in promo) if isinstance(promo, (set, frozenset)) else promo
        rows.append((first + dt.timedelta(days=i), sku, brand, segment, category, channel, region, "pack", float(price), p,
                     1.0, float(stock), float(u), float(u)))
    return rows


@pytest.fixture
def daily(spark):
    return lambda rows: spark.createDataFrame(rows, DAILY_SCHEMA)


@pytest.fixture
def folder():
    """A new folder per test; nothing is removed afterwards."""
    path = f"/tmp/tidepanel-test-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def rows_by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
