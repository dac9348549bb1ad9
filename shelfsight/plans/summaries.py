"""Mergeable summaries of the daily rows, written with the tables and merged by the analyses.

``pair_months`` has one row per month, store, product and region name, ``day_totals`` one per date, season, promotion
flag and whether the row is in the fact. Both hold counts, whole sums and extremes only, so merging them in any order
gives what the daily rows give; the daily rows are read once, at load. A row without a region is not in the fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsight.functions.calendar import month_key
from shelfsight.functions.numeric import cents, moments, quotient_sums, ratio
from shelfsight.model import PARTITION, STAGING_SCHEMA, Tables

#: Stock levels that analyses take as limits unless told otherwise; other limits are counted from the daily rows.
LEVELS = (0, 50)
MONTH_KEYS = [PARTITION, "store_id", "product_id", "region"]
DAY_KEYS = ["txn_date", "in_fact", "seasonality", "holiday_promotion"]
IN_FACT = "in_fact"


def revenue_cents() -> Column:
    """Sum of units at the row's own price, in hundredths."""
    return F.sum(F.col("units_sold").cast("bigint") * cents("price"))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def level_names(limit: float) -> tuple[str, str, str]:
    """Names of what at_level counts."""
    of = str(limit).replace("-", "minus_").replace(".", "_")
    return f"low_{of}", f"high_{of}", f"sold_above_{of}"


def at_level(limit: float) -> list[Column]:
    """Rows on either side of a stock level, and what was sold above it."""
    low, high, sold = level_names(limit)
    above = F.when(F.col("inventory_level") > limit, F.col("units_sold"))
    return [
        count_where(F.col("inventory_level") <= limit).alias(low),
        count_where(F.col("inventory_level") > limit).alias(high),
        F.sum(above).alias(f"{sold}_sum"),
        F.count(above).alias(f"{sold}_n"),
    ]


def pair_months(staging: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    off_forecast = F.abs(F.col("units_ordered").cast("bigint") * 100 - cents("demand_forecast"))
    return staging.groupBy(month_key(F.col("txn_date")).alias(PARTITION), *MONTH_KEYS[1:]).agg(
        F.count(F.lit(1)).alias("rows"),
        *moments("units_sold", "sold"),
        *moments("units_ordered", "ordered"),
        F.max("units_sold").alias("peak"),
        F.sum("inventory_level").alias("stock_sum"),
        F.count("inventory_level").alias("stock_n"),
        F.min("inventory_level").alias("lowest"),
        count_where(F.col("inventory_level") == 0).alias("stockouts"),
        F.max("txn_date").alias("last_date"),
        F.max_by("inventory_level", "txn_date").alias("last_level"),
        revenue_cents().alias("earned"),
        F.sum(cents("demand_forecast")).alias("planned_sum"),
        F.count("demand_forecast").alias("planned_n"),
        F.sum(off_forecast).alias("off_sum"),
        F.count(off_forecast).alias("off_n"),
        *quotient_sums(ratio("units_sold", "units_ordered"), "filled"),
        *[column for limit in levels for column in at_level(limit)],
    )


def day_totals(staging: DataFrame) -> DataFrame:
    cover = F.when(F.col("units_sold") > 0, ratio("inventory_level", "units_sold"))
    return staging.groupBy(
        "txn_date", F.col("region").isNotNull().alias(IN_FACT), "seasonality", "holiday_promotion"
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("units_sold").alias("sold_sum"),
        F.count("units_sold").alias("sold_n"),
        revenue_cents().alias("earned"),
        F.sum(cents("demand_forecast")).alias("planned_sum"),
        F.count("demand_forecast").alias("planned_n"),
        F.sum("inventory_level").alias("stock_sum"),
        F.count("inventory_level").alias("stock_n"),
        count_where(F.col("inventory_level") == 0).alias("stockouts"),
        count_where(F.col("units_sold") == 0).alias("zero_sales"),
        *quotient_sums(cover, "cover"),
        count_where(F.col("units_sold") > F.col("demand_forecast")).alias("under_forecast"),
    )


SUMMARIES = {"pair_months": pair_months, "day_totals": day_totals}


def summary_schema(spark, name: str) -> T.StructType:
    return SUMMARIES[name](spark.createDataFrame([], STAGING_SCHEMA)).schema


def months(tables: Tables, limit: int | None = None) -> DataFrame:
    """The summary per month and pair of all staging rows, the stored one if it knows ``limit``."""
    if limit is not None and limit not in LEVELS:
        return pair_months(tables.staging, (limit,))
    return pair_months(tables.staging) if tables.pair_months is None else tables.pair_months


def fact_months(tables: Tables) -> DataFrame:
    return months(tables).filter(F.col("region").isNotNull())


def days(tables: Tables) -> DataFrame:
    return day_totals(tables.staging) if tables.day_totals is None else tables.day_totals


def fact_days(tables: Tables) -> DataFrame:
    return days(tables).filter(IN_FACT)


def merged(summary: DataFrame, keys: list, *sums: str) -> DataFrame:
    """The named counts and sums per ``keys``."""
    return summary.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])

