import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from emberfold.session import build_session  # noqa: E402

UTC = timezone.utc
START = datetime(2025, 3, 5, tzinfo=UTC)
NOW = START + timedelta(hours=12, minutes=40)
DAY = START.date()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    return session


FIELDS = ["latitude", "longitude", "confidence", "acq_date", "acq_time", "satellite", "frp"]
RAW = ", ".join(f"{name} string" for name in FIELDS)


def where(north=0, east=0):
    """A place so many metres from the base, as latitude and longitude with five decimals."""
    return round(38.75 + north / 111_195.0, 5), round(-7.25 + east / 86_719.0, 5)


def seen(minutes=600, north=0, east=0, frp=6, level="n", craft="N21", **fields):
    """A raw row: an observation so many minutes after START and so far from the base."""
    latitude, longitude = where(north, east)
    moment = START + timedelta(minutes=minutes)
    row = dict(zip(FIELDS, (latitude, longitude, level, moment.date(), moment.strftime("%H%M"), craft, frp)))
    row.update(fields)
    return tuple(None if v is None else str(v) for v in row.values())


@pytest.fixture
def raw(spark):
    return lambda *rows: spark.createDataFrame(list(rows), RAW)
