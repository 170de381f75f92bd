from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from panelcast.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def hourly_rows():
    """Three series of hours with the awkward cases.

    Series a crosses ISO week 53 (early January 2021), misses one day, has one
    day without values and one NaN; series b has a leap day; series c one row.
    """
    rows = []
    start = datetime(2020, 12, 20)
    for h in range(45 * 24):
        ts = start + timedelta(hours=h)
        if ts.date() == datetime(2021, 1, 10).date():
            continue
        value = None if ts.date() == datetime(2021, 1, 15).date() else float((h * 7) % 31)
        if h == 100:
            value = float("nan")
        rows.append(("a", ts, value, float(h % 5), h % 4))
    rows.append(("a", start + timedelta(hours=45 * 24), 3.0, 1.0, 2))  # the next midnight
    start = datetime(2024, 2, 1)
    for h in range(45 * 24):
        rows.append(("b", start + timedelta(hours=h), float((h * 3) % 17), float(h % 3), h % 3))
    rows.append(("c", datetime(2021, 1, 3, 12), 5.0, 1.0, 1))
    return rows


@pytest.fixture(scope="session")
def hourly(spark, hourly_rows):
    schema = "series_id string, ts timestamp_ntz, temperature double, precipitation double, code int"
    return spark.createDataFrame(hourly_rows, schema)
