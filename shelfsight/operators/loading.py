"""Staging to star schema and flat model, row counts and profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions.calendar import date_attributes, month_key
from shelfsight.model import FACT_COLUMNS, PARTITION, SCHEMAS, STAR_TABLES, STAGING_COLUMNS, Tables


def staging_row_count(tables: Tables) -> DataFrame:
    return tables.staging.agg(F.count(F.lit(1)).alias("staging_rows"))


def build_dim_date(staging: DataFrame) -> DataFrame:
    """One row per date and season; attributes are derived after the distinct."""
    days = staging.select(
        F.col("txn_date").alias("date_key"), F.col("seasonality").alias("season")
    ).distinct()
    named = days.select("date_key", "season", *date_attributes(F.col("date_key")))
    return named.select(*SCHEMAS["dim_date"].fieldNames())


def build_dim_product(staging: DataFrame) -> DataFrame:
    return staging.select("product_id", "category").distinct()


def build_dim_store(staging: DataFrame) -> DataFrame:
    return staging.select("store_id").distinct()


def build_dim_region(staging: DataFrame) -> DataFrame:
    """Region names numbered alphabetically. The window sees the distinct names only."""
    names = staging.select(F.col("region").alias("region_name")).distinct()
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("region_name")))
    return names.select(number.cast("int").alias("region_id"), "region_name")


def build_fact(staging: DataFrame, dim_region: DataFrame) -> DataFrame:
    """Staging with the region resolved to its key; rows of unknown region drop out."""
    renamed = staging.withColumnsRenamed(
        {"discount": "discount_pct", "competitor_pricing": "competitor_price"}
    )
    return renamed.join(dim_region, renamed["region"] == dim_region["region_name"]).select(
        *FACT_COLUMNS, month_key(F.col("txn_date")).alias(PARTITION)
    )


def first_seen_products(staging: DataFrame) -> DataFrame:
    """Category and price of each product on its earliest row.

    "Earliest" is the lowest date, then store, category and price. The lowest row per
    product is picked inside each task, so one row per product and task is shuffled,
    however many products there are. The price is a local sort of five columns. Rows
    without a product or date are no first row.
    """
    first = F.min(F.struct("txn_date", "store_id", "category", "price")).alias("first")
    dated = staging.dropna(subset=["product_id", "txn_date"])
    return dated.groupBy("product_id").agg(first).select("product_id", "first.category", "first.price")


def star_from_staging(staging: DataFrame) -> Tables:
    """All tables as lazy plans over ``staging``, nothing written. For small inputs;
    larger ones go through sources.parquet_tables.persist_star_schema."""
    regions = build_dim_region(staging)
    return Tables(
        staging=staging,
        dim_date=build_dim_date(staging),
        dim_product=build_dim_product(staging),
        dim_store=build_dim_store(staging),
        dim_region=regions,
        fact=build_fact(staging, regions),
        products=first_seen_products(staging),
    )


def table_row_counts(tables: Tables) -> DataFrame:
    counts = [
        tables.table(name)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(name).alias("table_name"), "rows")
        for name in STAR_TABLES
    ]
    return reduce(DataFrame.unionAll, counts)


# --- flat model -----------------------------------------------------------------


def flat_stores(tables: Tables) -> DataFrame:
    return tables.dim_store.select(F.col("store_id").alias("Store ID"))


def flat_products(tables: Tables) -> DataFrame:
    return tables.products.select(
        F.col("product_id").alias("Product ID"),
        F.col("category").alias("Category"),
        F.col("price").alias("Price"),
    )


def flat_inventory_log(tables: Tables) -> DataFrame:
    left_out = {"category", "price", "weather_condition"}
    return tables.staging.select(
        *[F.col(name).alias(header) for header, name, _, _ in STAGING_COLUMNS if name not in left_out]
    )


# --- profile --------------------------------------------------------------------


def profile(df: DataFrame) -> DataFrame:
    """Type, filled values and row count per column, in one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(f"`{name}`")).alias(f"c{i}") for i, name in enumerate(df.columns)],
    )
    lines = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("column_type"),
            F.col(f"c{i}").alias("non_null"),
            F.col("rows"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counted.select(F.inline(F.array(*lines)))


def profile_staging(tables: Tables) -> DataFrame:
    return profile(tables.staging)


def first_rows(tables: Tables, n: int = 5) -> DataFrame:
    return tables.staging.orderBy("txn_date", "store_id", "product_id").limit(n)
