"""Inventory staging derived from order lines.

The sample tables hold no inventory, so a day's lines of one brand from one nation's
suppliers stand for the daily row of a (store, product): nation as store, brand as
product, nation's region as region. Stock and weather are arithmetic on the line keys
and carry no meaning. Remainders are taken per row, so the sums stay small however many
lines fall together.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.model import STAGING_SCHEMA

# Labels by remainder and by month.
WEATHER = ["Sunny", "Cloudy", "Rainy", "Snowy"]
SEASONS = ["Winter", "Spring", "Summer", "Autumn"]

STOCK_LEVELS = 301
CATEGORIES = 5
PROMOTION_FROM = 0.08


def _label(labels: list[str], index) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), index.cast("int") + 1)


def staging_from_orderlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 staging columns, one row per (ship date, nation, brand, region).

    Joins carry no hints: Spark broadcasts a side whose size allows it and otherwise
    shuffles both, splitting skewed keys at run time. Each right side is a plain scan, so
    that size is the file's and not a guess about a join. Lines are combined per group
    before the aggregation's shuffle.
    """

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    lines = (
        read("lineitem")
        .join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )

    order, part, quantity = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity")
    grouped = lines.groupBy(
        F.col("l_shipdate").cast("date").alias("txn_date"),
        F.col("n_name").alias("store_id"),
        F.col("p_brand").alias("product_id"),
        F.col("r_name").alias("region"),
    ).agg(
        F.sum(order % STOCK_LEVELS).alias("orders_left"),
        F.sum(part % STOCK_LEVELS).alias("parts_left"),
        F.sum(F.when(F.col("l_returnflag") != "R", quantity)).alias("sold"),
        F.sum(F.when(F.col("l_linestatus") == "O", quantity)).alias("ordered"),
        F.sum(quantity).alias("quantity"),
        F.sum(order % 7).alias("by_seven"),
        F.sum(order % 4).alias("by_four"),
        F.max("p_retailprice").alias("highest"),
        F.min("p_retailprice").alias("lowest"),
        F.max("l_discount").alias("discount_rate"),
    )

    brand_number = F.substring_index("product_id", "#", -1).cast("int")
    forecast = F.col("quantity").cast("decimal(18,2)") * F.lit(Decimal("0.90")) + (
        F.col("by_seven") % 7
    )
    promoted = F.col("discount_rate") >= PROMOTION_FROM
    columns = {
        "txn_date": F.col("txn_date"),
        "store_id": F.col("store_id"),
        "product_id": F.col("product_id"),
        "category": F.concat(F.lit("CAT_"), (brand_number % CATEGORIES).cast("string")),
        "region": F.col("region"),
        "inventory_level": (7 * F.col("orders_left") + 13 * F.col("parts_left")) % STOCK_LEVELS,
        "units_sold": F.coalesce("sold", F.lit(0.0)),
        "units_ordered": F.coalesce("ordered", F.lit(0.0)),
        "demand_forecast": forecast,
        "price": F.col("highest"),
        "discount": F.round(F.col("discount_rate") * 100),
        "weather_condition": _label(WEATHER, F.col("by_four") % 4),
        "holiday_promotion": F.when(promoted, 1).otherwise(0),
        "competitor_pricing": F.col("lowest"),
        "seasonality": _label(SEASONS, F.floor((F.month("txn_date") % 12) / 3)),
    }
    return grouped.select(
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in STAGING_SCHEMA.fields]
    )
