"""Data model: CSV columns, table schemas, and the set of tables analyses run on."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

# CSV header, staging column, type, longest text allowed.
STAGING_COLUMNS = [
    ("Date", "txn_date", T.DateType(), None),
    ("Store ID", "store_id", T.StringType(), 10),
    ("Product ID", "product_id", T.StringType(), 10),
    ("Category", "category", T.StringType(), 50),
    ("Region", "region", T.StringType(), 20),
    ("Inventory Level", "inventory_level", T.IntegerType(), None),
    ("Units Sold", "units_sold", T.IntegerType(), None),
    ("Units Ordered", "units_ordered", T.IntegerType(), None),
    ("Demand Forecast", "demand_forecast", MONEY, None),
    ("Price", "price", MONEY, None),
    ("Discount", "discount", T.IntegerType(), None),
    ("Weather Condition", "weather_condition", T.StringType(), 20),
    ("Holiday/Promotion", "holiday_promotion", T.ShortType(), None),
    ("Competitor Pricing", "competitor_pricing", MONEY, None),
    ("Seasonality", "seasonality", T.StringType(), 20),
]


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STAGING_SCHEMA = _struct(*[(name, kind) for _, name, kind, _ in STAGING_COLUMNS])

# Columns of the modelled tables.
SCHEMAS = {
    "staging_inventory": STAGING_SCHEMA,
    "dim_date": _struct(
        ("date_key", T.DateType()),
        ("day", T.ShortType()),
        ("month", T.ShortType()),
        ("month_name", T.StringType()),
        ("quarter", T.ShortType()),
        ("year", T.ShortType()),
        ("day_of_week", T.ShortType()),
        ("day_name", T.StringType()),
        ("is_weekend", T.BooleanType()),
        ("season", T.StringType()),
        ("week_of_year", T.ShortType()),
    ),
    "dim_product": _struct(("product_id", T.StringType()), ("category", T.StringType())),
    "dim_store": _struct(("store_id", T.StringType())),
    "dim_region": _struct(("region_id", T.IntegerType()), ("region_name", T.StringType())),
    "fact_inventory_daily": _struct(
        ("txn_date", T.DateType()),
        ("store_id", T.StringType()),
        ("product_id", T.StringType()),
        ("region_id", T.IntegerType()),
        ("inventory_level", T.IntegerType()),
        ("units_sold", T.IntegerType()),
        ("units_ordered", T.IntegerType()),
        ("demand_forecast", MONEY),
        ("price", MONEY),
        ("discount_pct", T.IntegerType()),
        ("competitor_price", MONEY),
        ("weather_condition", T.StringType()),
        ("holiday_promotion", T.ShortType()),
    ),
    "products": _struct(
        ("product_id", T.StringType()), ("category", T.StringType()), ("price", MONEY)
    ),
}

# The fact's directories are split by this extra column, derived from txn_date.
PARTITION = "txn_month"
FACT_COLUMNS = SCHEMAS["fact_inventory_daily"].fieldNames()
STAR_TABLES = ("fact_inventory_daily", "dim_date", "dim_product", "dim_store", "dim_region")

# Longest text allowed in the modelled tables.
TEXT_LIMITS = {
    "staging_inventory": {name: limit for _, name, _, limit in STAGING_COLUMNS if limit},
    "dim_date": {"month_name": 10, "day_name": 10, "season": 20},
    "dim_product": {"product_id": 10, "category": 50},
    "dim_store": {"store_id": 10},
    "dim_region": {"region_name": 20},
    "fact_inventory_daily": {"store_id": 10, "product_id": 10, "weather_condition": 20},
}


@dataclass(frozen=True)
class Tables:
    """The staging table, the star schema and the flat product list.

    ``fact`` carries the partition column besides its own columns. ``pair_months`` and
    ``day_totals`` are the written summaries of plans.summaries; without them the analyses
    summarise staging themselves.
    """

    staging: DataFrame
    dim_date: DataFrame
    dim_product: DataFrame
    dim_store: DataFrame
    dim_region: DataFrame
    fact: DataFrame
    products: DataFrame
    pair_months: DataFrame | None = None
    day_totals: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name == "fact_inventory_daily":
            return self.fact.select(*FACT_COLUMNS)
        return self.staging if name == "staging_inventory" else getattr(self, name)

    @cached_property
    def as_of(self) -> dt.date | None:
        """Latest date in the fact, read once and used as a literal in window filters.

        The newest month comes from the small date dimension, so normally only that
        month's directory of the fact is read.
        """
        newest = self.dim_date.agg(F.max("date_key")).first()[0]
        if newest is None:
            return None
        month = F.col(PARTITION) == newest.year * 100 + newest.month
        latest = F.max("txn_date")
        return (
            self.fact.filter(month).agg(latest).first()[0] or self.fact.agg(latest).first()[0]
        )
