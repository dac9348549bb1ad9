from __future__ import annotations

import datetime as dt
import pathlib
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from shelfsight.model import STAGING_SCHEMA  # noqa: E402
from shelfsight.operators.loading import star_from_staging  # noqa: E402
from shelfsight.workspace import local_session  # noqa: E402

DEFAULTS = {
    "txn_date": dt.date(2023, 1, 1),
    "store_id": "S1",
    "product_id": "P1",
    "category": "Toys",
    "region": "North",
    "inventory_level": 100,
    "units_sold": 10,
    "units_ordered": 10,
    "demand_forecast": Decimal("10.00"),
    "price": Decimal("2.50"),
    "discount": 0,
    "weather_condition": "Sunny",
    "holiday_promotion": 0,
    "competitor_pricing": Decimal("2.40"),
    "seasonality": "Winter",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int) -> dt.date:
    """The n-th day of 2023, counted from 0."""
    return dt.date(2023, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="session")
def staging(spark):
    """Staging frame from partial rows; missing columns take defaults, prices are decimal."""

    def build(rows: list[dict]):
        full = []
        for row in rows:
            values = {**DEFAULTS, **row}
            for name in ("price", "demand_forecast", "competitor_pricing"):
                if values[name] is not None:
                    values[name] = Decimal(str(values[name]))
            full.append(tuple(values[name] for name in DEFAULTS))
        return spark.createDataFrame(full, STAGING_SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def star(staging):
    return lambda rows: star_from_staging(staging(rows))


def records(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]
