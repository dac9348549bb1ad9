"""The written recommendations as queries: supply behind demand, thin class A stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight import params as P
from shelfsight.functions.numeric import as_double, from_cents, mean_of, ratio, round_to
from shelfsight.model import Tables
from shelfsight.operators.exploratory import days_of_supply, percentile_classes
from shelfsight.plans.cores import PAIR, category_totals, trailing


def trailing_velocity_gap(tables: Tables, window: int = 7) -> DataFrame:
    """Pairs that ordered less than they sold in the trailing window, widest gap first."""
    sums = (
        trailing(tables, window)
        .groupBy(*PAIR)
        .agg(
            F.sum("units_ordered").alias("units_ordered"),
            F.sum("units_sold").alias("sold_sum"),
            F.count("units_sold").alias("sold_n"),
        )
        .withColumn("shortfall", F.col("sold_sum") - F.col("units_ordered"))
    )
    return (
        sums.filter(F.col("shortfall") > 0)
        .select(
            *PAIR,
            "units_ordered",
            F.col("sold_sum").alias("units_sold"),
            round_to(mean_of("sold"), 2).alias("avg_daily_sales"),
            "shortfall",
        )
        .orderBy(F.desc("shortfall"), *PAIR)
    )


def critical_class_a(tables: Tables, days: float = 1.5) -> DataFrame:
    """Products of the top class by percent rank of revenue whose mean stock covers fewer
    than ``days`` days of mean sales."""
    top = F.col("ABC_Classification") == P.RANK_CLASS_NAMES[0]
    class_a = percentile_classes(tables).filter(top)
    thin = days_of_supply(tables).filter(F.col("supply") < F.lit(float(days)))
    return (
        class_a.join(thin, "product_id")
        .select(
            "product_id",
            "category",
            as_double(from_cents("earned")).alias("revenue"),
            round_to(F.col("supply"), 2).alias("days_of_supply"),
        )
        .orderBy("days_of_supply", "product_id")
    )


def category_days_of_supply(tables: Tables) -> DataFrame:
    """Mean stock over mean sales per category."""
    totals = category_totals(tables, [], "stock_sum", "stock_n", "sold_sum", "sold_n")
    return totals.select(
        "category",
        round_to(mean_of("stock"), 1).alias("avg_inventory"),
        round_to(mean_of("sold"), 1).alias("avg_daily_sales"),
        round_to(ratio(mean_of("stock"), mean_of("sold")), 2).alias("days_of_supply"),
    ).orderBy(F.asc_nulls_last("days_of_supply"), "category")
