"""Aggregations several analyses start from."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.numeric import EXACT, mean_of, moments, sample_sd_of
from shelfsight.model import PARTITION, Tables
from shelfsight.params import ReorderPolicy
from shelfsight.plans.summaries import fact_months, merged

PAIR = ["store_id", "product_id"]


def trailing(tables: Tables, days: int) -> DataFrame:
    """Fact rows from ``days`` before the latest date on, both ends included.

    Both bounds are literals: the month bound prunes directories, the date bound is
    pushed to the Parquet scan.
    """
    if tables.as_of is None:
        return tables.fact
    start = tables.as_of - dt.timedelta(days=days)
    first_month = start.year * 100 + start.month
    return tables.fact.filter(
        (F.col(PARTITION) >= F.lit(first_month)) & (F.col("txn_date") >= F.lit(start))
    )


def pair_stats(rows: DataFrame) -> DataFrame:
    """Per (store, product): last stock level and its date, demand moments and peak.

    Everything comes from one hash aggregation. Given the rows of a trailing window this
    still finds the overall last level, because a pair with rows in the window has its
    last row there too.
    """
    return rows.groupBy(*PAIR).agg(
        F.max("txn_date").alias("as_of_date"),
        F.max_by("inventory_level", "txn_date").alias("on_hand"),
        F.max("units_sold").alias("peak_demand"),
        *moments("units_sold", "demand"),
    )


def pair_history(tables: Tables) -> DataFrame:
    """pair_stats over the whole fact, merged from its months."""
    return fact_months(tables).groupBy(*PAIR).agg(
        F.max("last_date").alias("as_of_date"),
        F.max_by("last_level", "last_date").alias("on_hand"),
        F.max("peak").alias("peak_demand"),
        *[F.sum(f"sold_{part}").alias(f"demand_{part}") for part in ("n", "sum", "sumsq")],
    )


def with_reorder_levels(stats: DataFrame, policy: ReorderPolicy) -> DataFrame:
    """Add unrounded cycle stock, safety stock, reorder point and stock ceiling.

    Safety stock, and all that contains it, is NULL for a pair with a single row.
    """
    cycle = mean_of("demand") * F.lit(float(policy.lead_time_days))
    safety = (
        F.lit(float(policy.z_score))
        * sample_sd_of("demand")
        * F.sqrt(F.lit(float(policy.lead_time_days)))
    )
    return stats.withColumns({"cycle": cycle, "safety": safety}).withColumns(
        {
            "reorder_at": F.col("cycle") + F.col("safety"),
            "ceiling": F.col("cycle") * F.lit(float(policy.max_factor)) + F.col("safety"),
        }
    )


def advice(on_hand: str, low: str, high: str, below: Column, above: Column, within: Column):
    """Pick by position against two levels; an unknown level counts as within."""
    return (
        F.when(F.col(on_hand) < F.col(low), below)
        .when(F.col(on_hand) > F.col(high), above)
        .otherwise(within)
    )


def product_revenue(tables: Tables) -> DataFrame:
    """Units and revenue, in hundredths, per product and category.

    The months are reduced to one row per product before the category is joined on, so the
    join's size is that of the product list.
    """
    totals = merged(fact_months(tables), ["product_id"], "sold_sum", "earned")
    return totals.join(tables.dim_product, "product_id").select(
        "product_id", "category", F.col("sold_sum").alias("units_sold"), "earned"
    )


def category_totals(tables: Tables, extra_keys: list[str], *sums: str) -> DataFrame:
    """Sums of the fact's months per category and further keys, by way of per-product sums. Money
    per product fits a bigint; above that it is added up as exact decimals."""

    def part(name: str) -> Column:
        return F.col(name).cast(EXACT) if name == "earned" else F.col(name)

    return (
        merged(fact_months(tables), ["product_id", *extra_keys], *sums)
        .join(tables.dim_product, "product_id")
        .groupBy("category", *extra_keys)
        .agg(*[F.sum(part(name)).alias(name) for name in sums])
    )
