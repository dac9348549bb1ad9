"""The exploratory suite over the flat model: daily log and first-seen product list.

Every analysis merges the log's months to products first and joins the product list afterwards.
Result columns keep the log's own header names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight import params as P
from shelfsight.functions.numeric import EXACT, as_double, cents, exact_sum, from_cents, mean_of, ratio, round_to
from shelfsight.model import PARTITION, Tables
from shelfsight.plans.ranking import class_by, percent_rank, with_descending_order
from shelfsight.plans.summaries import days, level_names, merged, months


def _product() -> Column:
    return F.col("product_id").alias("Product ID")


def _category() -> Column:
    return F.col("category").alias("Category")


def _per_product(tables: Tables, *sums: str, limit: int | None = None) -> DataFrame:
    return merged(months(tables, limit), ["product_id"], *sums)


def _with_category(per_product: DataFrame, tables: Tables) -> DataFrame:
    return per_product.join(tables.products.select("product_id", "category"), "product_id")


def stock_levels(tables: Tables, limit: int = 10) -> DataFrame:
    """Largest stock per category, product and region, summed over all days."""
    stock = merged(months(tables), ["product_id", "region"], "stock_sum", "stock_n")
    return (
        _with_category(stock, tables)
        .orderBy(F.desc_nulls_last("stock_sum"), "category", "product_id", "region")
        .limit(limit)
        .select(
            _category(),
            _product(),
            F.col("region").alias("Region"),
            F.col("stock_sum").alias("Total_Current_Stock"),
            mean_of("stock").alias("Avg_Daily_Stock"),
        )
    )


def turnover_top(tables: Tables, limit: int = 10) -> DataFrame:
    """Products with the highest ratio of units sold to mean stock, unrounded."""
    stats = _per_product(tables, "sold_sum", "stock_sum", "stock_n").withColumn("mean_stock", mean_of("stock"))
    turns = F.when(F.col("mean_stock") > 0, ratio("sold_sum", "mean_stock")).otherwise(F.lit(0.0))
    return (
        stats.select(
            _product(),
            F.col("sold_sum").alias("Total_Sold"),
            F.col("mean_stock").alias("Avg_Inventory"),
            turns.alias("Inventory_Turnover_Ratio"),
        )
        .orderBy(F.desc_nulls_last("Inventory_Turnover_Ratio"), "Product ID")
        .limit(limit)
    )


def reorder_risk(tables: Tables, days: int = 7, limit: int = 10) -> DataFrame:
    """Best sellers whose lowest stock falls short of ``days`` of mean sales."""
    stats = (
        months(tables).groupBy("product_id")
        .agg(F.sum("sold_sum").alias("sold_sum"), F.sum("sold_n").alias("sold_n"), F.min("lowest").alias("lowest"))
        .withColumn("pace", mean_of("sold"))
    )
    needed = F.col("pace") * F.lit(float(days))
    risk = F.when(F.col("lowest") < needed, P.HIGH_RISK).otherwise(P.HEALTHY)
    return (
        _with_category(stats, tables)
        .orderBy(F.desc_nulls_last("pace"), "product_id")
        .limit(limit)
        .select(
            _product(),
            _category(),
            round_to(F.col("pace"), 2).alias("Avg_Daily_Sales"),
            round_to(needed, 2).alias("Est_Reorder_Point"),
            F.col("lowest").alias("Current_Min_Inventory"),
            risk.alias("Stockout_Risk"),
        )
    )


def kpi_by_category(
    tables: Tables, threshold: int = 0, rate_name: str = "Stockout_Rate_Percent"
) -> DataFrame:
    """Product count, unweighted mean of product means, units, and share of days with
    stock at or below ``threshold``, per category."""
    low = level_names(threshold)[0]
    dated = F.when(F.col(PARTITION).isNotNull(), F.col("rows")).otherwise(0)
    products = merged(
        months(tables, threshold).withColumn("days", dated), ["product_id"], "days", low, "stock_sum",
        "stock_n", "sold_sum",
    ).withColumn("mean_stock", mean_of("stock"))
    mean = exact_sum(F.col("mean_stock")) / F.nullif(F.count("mean_stock"), F.lit(0))
    return (
        _with_category(products, tables)
        .groupBy("category")
        .agg(
            F.count("product_id").alias("Total_SKUs_in_Category"),
            round_to(mean, 0).alias("Average_Stock_Level"),
            F.sum("sold_sum").alias("Total_Units_Sold"),
            round_to(ratio(F.sum(low), F.sum("days")) * 100, 2).alias(rate_name),
        )
        .withColumnRenamed("category", "Category")
        .orderBy(F.desc_nulls_last(rate_name), "Category")
    )


def critical_by_category(tables: Tables, threshold: int = 50) -> DataFrame:
    return kpi_by_category(tables, threshold, "Critical_Stock_Rate_Percent")


def fast_vs_slow(tables: Tables, k: int = 2) -> DataFrame:
    """Products ranked up to ``k`` in their category by units sold, from either end.

    Ranks are taken over the distinct totals of a category with the number of products
    sharing each, of which only the ``k`` outermost per end can qualify. Products are
    matched back on their total, so ties of any size stay spread out.
    """
    totals = _with_category(_per_product(tables, "sold_sum").withColumnRenamed("sold_sum", "sold"), tables)
    levels = totals.groupBy("category", "sold").agg(F.count(F.lit(1)).alias("sharing"))

    def outermost(order: Column, status: str, position: int) -> DataFrame:
        by_total = Window.partitionBy("category").orderBy(order)
        before = F.sum("sharing").over(by_total.rowsBetween(Window.unboundedPreceding, -1))
        return (
            levels.withColumn("place", F.row_number().over(by_total))
            .filter(F.col("place") <= k)
            .withColumn("rank", F.coalesce(before, F.lit(0)) + 1)
            .filter(F.col("rank") <= k)
            .select("category", "sold", F.lit(position).alias("position"), F.lit(status).alias("status"))
        )

    fast = outermost(F.desc_nulls_last("sold"), P.FAST_SELLING, 1)
    slow = outermost(F.asc_nulls_first("sold"), P.SLOW_MOVING, 2)
    # A total reached from both ends counts as fast.
    marked = (
        fast.unionAll(slow)
        .groupBy(F.col("category").alias("of_category"), F.col("sold").alias("of_sold"))
        .agg(F.min_by("status", "position").alias("status"))
    )
    same = F.col("category").eqNullSafe(F.col("of_category")) & F.col("sold").eqNullSafe(
        F.col("of_sold")
    )
    return (
        totals.join(marked, same)
        .select(
            _category(),
            _product(),
            F.col("sold").alias("Total_Units_Sold"),
            F.col("status").alias("Product_Velocity_Status"),
        )
        .orderBy("Category", F.desc_nulls_last("Total_Units_Sold"), "Product ID")
    )


def days_of_supply(tables: Tables) -> DataFrame:
    """Mean stock, mean sales and their ratio per product."""
    return (
        _per_product(tables, "stock_sum", "stock_n", "sold_sum", "sold_n")
        .select("product_id", mean_of("stock").alias("mean_stock"), mean_of("sold").alias("pace"))
        .withColumn("supply", ratio("mean_stock", "pace"))
    )


def overstock(
    tables: Tables, high: float = 30, low: float = 7, limit: int = 10
) -> DataFrame:
    """Products with the most days of supply, and what to do about them."""
    action = (
        F.when(F.col("supply") > F.lit(float(high)), P.REDUCE_STOCK)
        .when(F.col("supply") < F.lit(float(low)), P.INCREASE_STOCK)
        .otherwise(P.OPTIMAL_STOCK)
    )
    return (
        _with_category(days_of_supply(tables), tables)
        .select(
            _product(),
            _category(),
            round_to(F.col("mean_stock"), 1).alias("Avg_Inventory_On_Hand"),
            round_to(F.col("pace"), 1).alias("Avg_Daily_Sales"),
            round_to(F.col("supply"), 1).alias("Days_Of_Supply"),
            action.alias("Recommended_Action"),
        )
        .orderBy(F.desc_nulls_last("Days_Of_Supply"), "Product ID")
        .limit(limit)
    )


def supply_gaps(tables: Tables, limit: int = 10) -> DataFrame:
    """Products whose orders fall furthest behind their sales."""
    totals = _per_product(tables, "ordered_sum", "sold_sum", "stock_sum", "stock_n")
    return (
        totals.select(
            _product(),
            F.col("ordered_sum").alias("Total_Units_Ordered"),
            F.col("sold_sum").alias("Total_Units_Sold"),
            (F.col("ordered_sum") - F.col("sold_sum")).alias("Net_Supply_Variance"),
            round_to(mean_of("stock"), 1).alias("Avg_Daily_Inventory"),
        )
        .orderBy(F.asc_nulls_first("Net_Supply_Variance"), "Product ID")
        .limit(limit)
    )


def seasonality(tables: Tables) -> DataFrame:
    """Mean sales and forecast per season and promotion flag."""
    return (
        merged(
            days(tables), ["seasonality", "holiday_promotion"], "sold_sum", "sold_n", "planned_sum", "planned_n"
        )
        .withColumn("sold", mean_of("sold"))
        .withColumn("forecast", ratio(from_cents("planned_sum"), "planned_n"))
        .select(
            F.col("seasonality").alias("Seasonality"),
            F.col("holiday_promotion").alias("Holiday/Promotion"),
            round_to(F.col("sold"), 2).alias("Avg_Units_Sold"),
            round_to(F.col("forecast"), 2).alias("Avg_Forecasted_Demand"),
            round_to(F.col("sold") - F.col("forecast"), 2).alias("Forecast_Error"),
        )
        .orderBy(F.desc_nulls_last("Avg_Units_Sold"), "Seasonality", "Holiday/Promotion")
    )


def lost_revenue(tables: Tables, threshold: int = 50) -> DataFrame:
    """Days at or below the threshold, valued at the pace of the days above it.

    Products without days on either side drop out.
    """
    low, high, above = level_names(threshold)
    dated = F.when(F.col(PARTITION).isNotNull(), F.col(low)).otherwise(0)
    stats = merged(
        months(tables, threshold).withColumn("missed", dated), ["product_id"], high, f"{above}_sum", f"{above}_n", low,
        "missed",
    ).filter((F.col(high) > 0) & (F.col(low) > 0))
    lost = as_double("missed") * mean_of(above) * as_double("price")
    return (
        stats.join(tables.products, "product_id")
        .groupBy(_category())
        .agg(round_to(exact_sum(lost), 2).alias("Estimated_Lost_Revenue"))
        .orderBy(F.desc_nulls_last("Estimated_Lost_Revenue"), "Category")
    )


def abc_percentile(tables: Tables, a: float = 0.20, b: float = 0.50) -> DataFrame:
    """Revenue per category and class of percentile_classes."""
    return (
        percentile_classes(tables, a, b).groupBy(_category(), "ABC_Classification")
        .agg(F.sum(F.col("earned").cast(EXACT)).alias("earned"))
        .select(
            "Category",
            "ABC_Classification",
            round_to(as_double(from_cents("earned")), 2).alias("Total_Category_Revenue"),
        )
        .orderBy("Category", "ABC_Classification")
    )


def percentile_classes(tables: Tables, a: float = 0.20, b: float = 0.50) -> DataFrame:
    """Products with revenue, in hundredths, and class by percent rank of revenue at the
    first-seen price. The price is constant per product and applied to its units."""
    valued = _per_product(tables, "sold_sum").join(tables.products, "product_id").select(
        "product_id", "category", (F.col("sold_sum") * cents("price")).alias("earned")
    )
    ordered = with_descending_order(valued, "earned", ["product_id", "category"])
    label = class_by(percent_rank(), (a, b), P.RANK_CLASS_NAMES)
    return ordered.select("product_id", "category", "earned", label.alias("ABC_Classification"))


# --- views on the results above ----------------------------------------------------


def high_risk(tables: Tables, limit: int = 10) -> DataFrame:
    """The high-risk rows among the products reorder_risk lists."""
    return reorder_risk(tables, limit=limit).filter(F.col("Stockout_Risk") == P.HIGH_RISK).limit(limit)


def fast_slow_extremes(tables: Tables, n: int = 5) -> DataFrame:
    """First and last ``n`` rows of fast_vs_slow in its order; a short list repeats rows."""
    rows = fast_vs_slow(tables)
    last = rows.orderBy(
        F.desc("Category"), F.asc_nulls_first("Total_Units_Sold"), F.desc("Product ID")
    )
    return rows.limit(n).unionAll(last.limit(n))


def season_label(tables: Tables) -> DataFrame:
    """Seasonality rows under one text label of season and promotion flag."""
    label = F.concat(
        "Seasonality", F.lit(" (Promo: "), F.col("Holiday/Promotion").cast("string"), F.lit(")")
    )
    return seasonality(tables).select(
        label.alias("Season_Label"), "Avg_Units_Sold", "Avg_Forecasted_Demand"
    )


def pivot_abc(tables: Tables) -> DataFrame:
    """abc_percentile with a column per class, 0 where a category has none."""
    return (
        abc_percentile(tables)
        .groupBy("Category")
        .pivot("ABC_Classification", list(P.RANK_CLASS_NAMES))
        .agg(F.sum("Total_Category_Revenue"))
        .fillna(0.0)
        .orderBy("Category")
    )
