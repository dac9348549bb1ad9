"""The production suite: stock, reorder, turnover, KPI, ABC, ordering, demand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight import params as P
from shelfsight.functions.numeric import (
    EXACT,
    as_double,
    cents,
    from_cents,
    mean_of,
    percent,
    quotient_total,
    ratio,
    round_to,
    sample_sd_of,
)
from shelfsight.model import Tables
from shelfsight.params import ReorderPolicy
from shelfsight.plans.cores import (
    advice,
    category_totals,
    pair_history,
    pair_stats,
    product_revenue,
    trailing,
    with_reorder_levels,
)
from shelfsight.plans.ranking import class_by, with_descending_order
from shelfsight.plans.summaries import fact_days, fact_months, merged

POLICY = ReorderPolicy()


def current_stock_levels(tables: Tables, window: int = 30) -> DataFrame:
    """Last stock level per pair with recent demand, and the days it covers.

    Pairs without a row in the window are left out, so the window is all that is read.
    """
    stats = pair_stats(trailing(tables, window))
    demand = mean_of("demand")
    return (
        stats.join(tables.dim_product, "product_id")
        .select(
            "store_id",
            "product_id",
            "category",
            "as_of_date",
            "on_hand",
            round_to(demand, 2).alias("avg_daily_demand_30d"),
            round_to(ratio("on_hand", demand), 1).alias("days_of_cover"),
        )
        .orderBy(F.asc_nulls_last("days_of_cover"), "store_id", "product_id")
    )


def low_inventory_alerts(
    tables: Tables, policy: ReorderPolicy = POLICY, window: int = 90
) -> DataFrame:
    """Pairs at or below the reorder point of the window's demand, most urgent first."""
    levels = with_reorder_levels(pair_stats(trailing(tables, window)), policy)
    low = levels.filter(F.col("on_hand") <= F.col("reorder_at"))
    status = F.when(F.col("on_hand") == 0, P.STOCKOUT).otherwise(P.REORDER_NOW)
    return (
        low.join(tables.dim_product, "product_id")
        .orderBy(F.desc(F.col("reorder_at") - F.col("on_hand")), "store_id", "product_id")
        .select(
            "store_id",
            "product_id",
            "category",
            "on_hand",
            round_to(F.col("cycle"), 0).alias("cycle_stock"),
            round_to(F.col("safety"), 0).alias("safety_stock"),
            round_to(F.col("reorder_at"), 0).alias("reorder_point"),
            status.alias("status"),
        )
    )


def reorder_points(tables: Tables, policy: ReorderPolicy = POLICY) -> DataFrame:
    """Demand statistics and stock levels of every pair over its full history."""
    levels = with_reorder_levels(pair_history(tables), policy)
    return (
        levels.join(tables.dim_product, "product_id")
        .select(
            "store_id",
            "product_id",
            "category",
            round_to(mean_of("demand"), 1).alias("avg_daily_demand"),
            round_to(sample_sd_of("demand"), 1).alias("demand_std_dev"),
            "peak_demand",
            round_to(F.col("cycle"), 0).alias("cycle_stock"),
            round_to(F.col("safety"), 0).alias("safety_stock"),
            round_to(F.col("reorder_at"), 0).alias("reorder_point"),
            round_to(F.col("ceiling"), 0).alias("max_stock_level"),
        )
        .orderBy("store_id", F.desc_nulls_last("reorder_point"), "product_id")
    )


def turnover(tables: Tables, window: int = 365) -> DataFrame:
    """Units sold in the window against mean stock per product, and the days one stock
    lasts at that pace."""
    totals = (
        trailing(tables, window)
        .groupBy("product_id")
        .agg(
            F.sum("units_sold").alias("total_units_sold"),
            F.sum("inventory_level").alias("stock_sum"),
            F.count("inventory_level").alias("stock_n"),
        )
        .withColumn("stock", ratio("stock_sum", "stock_n"))
        .withColumn("turns", ratio("total_units_sold", "stock"))
    )
    return (
        totals.join(tables.dim_product, "product_id")
        .select(
            "category",
            "product_id",
            "total_units_sold",
            round_to(F.col("stock"), 1).alias("avg_inventory"),
            round_to(F.col("turns"), 2).alias("turnover_ratio"),
            round_to(ratio(F.lit(float(window)), "turns"), 1).alias("days_inventory_outstanding"),
        )
        .orderBy(F.desc_nulls_last("turnover_ratio"), "category", "product_id")
    )


def window_kpis(tables: Tables, window: int) -> DataFrame:
    """Additive KPI parts of the window in one row, from the totals per date."""
    in_window = fact_days(tables)
    if tables.as_of is not None:
        start = tables.as_of - dt.timedelta(days=window)
        in_window = in_window.filter(F.col("txn_date") >= F.lit(start))
    parts = (
        "rows", "sold_sum", "earned", "stock_sum", "stock_n", "stockouts", "zero_sales", "cover_whole", "cover_fraction",
        "cover_n", "under_forecast",
    )
    by_day = merged(in_window, ["txn_date"], *parts)
    return (
        by_day.agg(
            F.count("txn_date").alias("days_in_window"),
            *[F.sum(F.col(name).cast(EXACT) if name == "earned" else name).alias(name) for name in parts],
        )
        .withColumnsRenamed({"rows": "fact_rows", "sold_sum": "units"})
        .withColumns({"stock": ratio("stock_sum", "stock_n"), "revenue": as_double(from_cents("earned"))})
    )


def kpi_summary(tables: Tables, window: int = 90) -> DataFrame:
    """Headline figures of the window in one row."""
    return window_kpis(tables, window).select(
        "days_in_window",
        F.coalesce("fact_rows", F.lit(0)).alias("fact_rows"),
        F.col("units").alias("total_units_sold"),
        round_to(F.col("revenue"), 0).alias("gross_revenue"),
        round_to(F.col("stock"), 1).alias("avg_stock_level"),
        round_to(percent("stockouts", "fact_rows"), 2).alias("stockout_rate_pct"),
        round_to(percent("zero_sales", "fact_rows"), 2).alias("zero_sale_rate_pct"),
        round_to(ratio(quotient_total("cover"), "cover_n"), 1).alias("avg_days_of_cover"),
        round_to(ratio("units", "stock"), 2).alias("turnover_90d"),
        round_to(percent("under_forecast", "fact_rows"), 2).alias("forecast_under_pct"),
    )


def revenue_shares(tables: Tables) -> DataFrame:
    """Product revenue with rank, share and cumulative share in percent, unrounded."""
    ordered = with_descending_order(
        product_revenue(tables), "earned", ["product_id", "category"]
    )
    total = from_cents("total")
    return ordered.select(
        "product_id",
        "category",
        "units_sold",
        as_double(from_cents("earned")).alias("revenue"),
        "rank",
        percent(from_cents("earned"), total).alias("share"),
        percent(from_cents("running"), total).alias("cumulative_share"),
    )


def abc_analysis(tables: Tables, a: float = 70, b: float = 90) -> DataFrame:
    """Classes by cumulative revenue share, the product's own share included: one that
    crosses a limit belongs to the class below it."""
    shares = revenue_shares(tables)
    return shares.orderBy("rank", "product_id", "category").select(
        "product_id",
        "category",
        "units_sold",
        "revenue",
        round_to(F.col("share"), 2).alias("pct_of_revenue"),
        round_to(F.col("cumulative_share"), 2).alias("cumulative_pct"),
        class_by(F.col("cumulative_share"), (a, b), P.SHARE_CLASS_NAMES).alias("abc_class"),
    )


def stock_adjustments(tables: Tables, policy: ReorderPolicy = POLICY) -> DataFrame:
    """Advice per pair against the rounded reorder point and ceiling, with the units."""
    levels = with_reorder_levels(pair_history(tables), policy).select(
        "store_id",
        "product_id",
        "on_hand",
        round_to(F.col("reorder_at"), 0).alias("reorder_point"),
        round_to(F.col("ceiling"), 0).alias("target_max"),
    )
    position = ("on_hand", "reorder_point", "target_max")
    missing = F.col("target_max") - F.col("on_hand")
    action = advice(*position, F.lit(P.INCREASE), F.lit(P.DECREASE), F.lit(P.HOLD))
    units = advice(*position, missing, -missing, F.lit(0.0))
    return levels.select(
        "*", action.alias("action"), units.alias("units_to_adjust")
    ).orderBy("action", F.desc_nulls_last("units_to_adjust"), "store_id", "product_id")


def supplier_performance(tables: Tables) -> DataFrame:
    """Ordering behaviour per product, as a stand-in for the missing supplier data."""
    per_product = merged(
        fact_months(tables), ["product_id"], "rows", "ordered_n", "ordered_sum", "ordered_sumsq", "sold_sum", "sold_n",
        "planned_sum", "planned_n", "filled_whole", "filled_fraction", "filled_n", "off_sum", "off_n",
    )
    return (
        per_product.join(tables.dim_product, "product_id")
        .select(
            "product_id",
            "category",
            F.col("rows").alias("observation_days"),
            round_to(mean_of("ordered"), 1).alias("avg_units_ordered"),
            round_to(mean_of("sold"), 1).alias("avg_units_sold"),
            round_to(ratio(from_cents("planned_sum"), "planned_n"), 1).alias("avg_forecast"),
            round_to(ratio(quotient_total("filled"), "filled_n"), 3).alias("fill_rate_proxy"),
            round_to(sample_sd_of("ordered"), 1).alias("order_variability"),
            round_to(ratio(from_cents("off_sum"), "off_n"), 1).alias("order_vs_forecast_mae"),
        )
        .orderBy(F.desc_nulls_last("fill_rate_proxy"), "product_id", "category")
    )


def demand_forecast(
    tables: Tables, window: int = 60, short: int = 7, long: int = 30, lag: int = 7
) -> DataFrame:
    """Daily product demand in the window with moving means and weekly growth.

    The frames count rows and start with the window, so its first rows hold partial
    means. A product has at most one row per day here, whatever its share of the fact.
    """
    daily = (
        trailing(tables, window)
        .groupBy("product_id", "txn_date")
        .agg(
            F.sum("units_sold").alias("units_sold"),
            F.sum(cents("demand_forecast")).alias("planned"),
        )
    )
    days = Window.partitionBy("product_id").orderBy("txn_date")

    def moving_mean(rows: int):
        return F.avg("units_sold").over(days.rowsBetween(1 - rows, Window.currentRow))

    earlier = F.lag("units_sold", lag).over(days)
    return daily.select(
        "product_id",
        "txn_date",
        "units_sold",
        as_double(from_cents("planned")).alias("forecast"),
        round_to(moving_mean(short), 1).alias("ma_7d"),
        round_to(moving_mean(long), 1).alias("ma_30d"),
        round_to(percent(F.col("units_sold") - earlier, earlier), 1).alias("wow_growth_pct"),
    ).orderBy("product_id", "txn_date")


def stockout_by_category_region(tables: Tables) -> DataFrame:
    """Rows, empty-shelf rows and mean stock and sales per category and region."""
    totals = category_totals(
        tables, ["region"], "rows", "stockouts", "stock_sum", "stock_n", "sold_sum", "sold_n"
    )
    return totals.select(
        "category",
        F.col("region").alias("region_name"),
        F.col("rows").alias("fact_rows"),
        F.col("stockouts").alias("stockout_days"),
        round_to(percent("stockouts", "rows"), 3).alias("stockout_rate_pct"),
        round_to(mean_of("stock"), 1).alias("avg_inventory"),
        round_to(mean_of("sold"), 1).alias("avg_daily_sales"),
    ).orderBy("category", F.desc_nulls_last("stockout_rate_pct"), "region_name")
