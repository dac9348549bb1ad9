"""Datasets behind the dashboard and the steps applied to them; values unrounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight import params as P
from shelfsight.functions.calendar import month_label
from shelfsight.functions.numeric import (
    EXACT,
    as_double,
    from_cents,
    mean_of,
    percent,
    ratio,
    round_to,
)
from shelfsight.model import Tables
from shelfsight.operators.production import POLICY, revenue_shares, window_kpis
from shelfsight.params import ReorderPolicy
from shelfsight.plans.cores import (
    advice,
    category_totals,
    pair_history,
    with_reorder_levels,
)
from shelfsight.plans.ranking import class_by
from shelfsight.plans.summaries import fact_days, fact_months, merged


def kpi_cards(tables: Tables, window: int = 90) -> DataFrame:
    return window_kpis(tables, window).select(
        F.col("units").alias("units_sold"),
        "revenue",
        F.col("stock").alias("avg_stock"),
        percent("stockouts", "fact_rows").alias("stockout_pct"),
        ratio("units", "stock").alias("turnover"),
    )


def rolling_mean(daily: DataFrame, value: str, rows: int):
    """Mean over the last ``rows`` rows by date, partial at the start.

    The window has no partition keys: its input holds one row per date, so a century of
    history is under 40,000 rows.
    """
    by_date = Window.orderBy("txn_date").rowsBetween(1 - rows, Window.currentRow)
    return daily.withColumn(f"ma_{rows}", F.avg(value).over(by_date))


def daily_trend(tables: Tables, short: int = 7, long: int = 30) -> DataFrame:
    """Daily units, forecast and mean stock with moving means over the whole history."""
    daily = (
        merged(fact_days(tables), ["txn_date"], "sold_sum", "planned_sum", "stock_sum", "stock_n")
        .select(
            "txn_date",
            F.col("sold_sum").alias("units_sold"),
            as_double(from_cents("planned_sum")).alias("forecast"),
            mean_of("stock").alias("avg_inv"),
        )
    )
    smoothed = rolling_mean(rolling_mean(daily, "units_sold", short), "units_sold", long)
    return smoothed.orderBy("txn_date")


def moving_means(tables: Tables) -> DataFrame:
    return daily_trend(tables).select("txn_date", "units_sold", "ma_7", "ma_30")


def abc(tables: Tables, a: float = 70, b: float = 90) -> DataFrame:
    shares = revenue_shares(tables)
    return shares.orderBy(F.desc_nulls_last("revenue"), "product_id", "category").select(
        "product_id",
        "category",
        "units_sold",
        "revenue",
        F.col("share").alias("pct"),
        F.col("cumulative_share").alias("cum_pct"),
        class_by(F.col("cumulative_share"), (a, b), P.SHARE_CLASSES).alias("abc"),
    )


def top_products(tables: Tables, n: int = 15) -> DataFrame:
    """Products of highest revenue with their class."""
    return abc(tables).limit(n).select("product_id", "category", "revenue", "abc")


def category_sales(tables: Tables) -> DataFrame:
    totals = category_totals(tables, [], "earned", "sold_sum")
    return totals.select(
        "category", as_double(from_cents("earned")).alias("revenue"), F.col("sold_sum").alias("units")
    ).orderBy(F.desc_nulls_last("revenue"), "category")


def revenue_mix(tables: Tables) -> DataFrame:
    """Category share of revenue in percent."""
    sales = category_totals(tables, [], "earned")
    total = sales.agg(F.sum("earned")).scalar()
    return sales.select(
        "category",
        as_double(from_cents("earned")).alias("revenue"),
        round_to(percent(from_cents("earned"), from_cents(total)), 1).alias("share_pct"),
    ).orderBy(F.desc_nulls_last("revenue"), "category")


def sales_heat(tables: Tables) -> DataFrame:
    """Mean sales per category and region."""
    totals = category_totals(tables, ["region"], "sold_sum", "sold_n")
    return totals.select("category", F.col("region").alias("region_name"), mean_of("sold").alias("avg_sales"))


def pivot_category_region(tables: Tables) -> DataFrame:
    """sales_heat with a column per region, NULL where a category has no rows there.

    The region names are read first: a pivot's columns must be known to plan it.
    """
    names = [r[0] for r in tables.dim_region.orderBy("region_id").select("region_name").collect()]
    return (
        sales_heat(tables)
        .groupBy("category")
        .pivot("region_name", names)
        .agg(F.max("avg_sales"))
        .orderBy("category")
    )


def inventory_distribution(tables: Tables) -> DataFrame:
    return tables.fact.select("inventory_level")


def _level_counts(tables: Tables) -> DataFrame:
    return (
        tables.fact.filter(F.col("inventory_level").isNotNull())
        .groupBy(F.col("inventory_level").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def histogram(tables: Tables, bins: int = 40) -> DataFrame:
    """Rows per equal-width bin between lowest and highest stock level.

    Levels are counted first and binned in whole numbers. The last bin includes the
    highest level; bins without rows count 0. A single level gets a bin range of width 1
    around it. The range comes from the same counts: with ``n`` in it, column pruning
    leaves both plans alike and the counts are shuffled once for both.
    """
    levels = _level_counts(tables).withColumn("level", F.col("level").cast("bigint"))
    extent = levels.agg(
        F.struct(F.min("level").alias("lo"), F.max("level").alias("hi"), F.sum("n").alias("n"))
    ).scalar()
    lowest = extent.getField("lo")
    highest = extent.getField("hi")
    place = F.when(F.col("width") == 0, F.lit(bins // 2)).otherwise(
        F.least(
            F.floor((F.col("level") - F.col("lo")) * bins / F.nullif("width", F.lit(0))),
            F.lit(bins - 1),
        )
    )
    counts = (
        levels.select("level", "n", lowest.alias("lo"), (highest - lowest).alias("width"))
        .groupBy(place.cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    low = F.when(F.col("width") == 0, F.col("lo") - 0.5).otherwise(as_double("lo"))
    step = F.when(F.col("width") == 0, F.lit(1.0)).otherwise(as_double("width")) / float(bins)
    edges = (
        tables.fact.sparkSession.range(bins)
        .select(
            F.col("id").cast("int").alias("bin"),
            lowest.alias("lo"),
            (highest - lowest).alias("width"),
        )
        .filter(F.col("lo").isNotNull())
        .select(
            "bin",
            (low + F.col("bin") * step).alias("lower"),
            (low + (F.col("bin") + 1) * step).alias("upper"),
        )
    )
    return (
        edges.join(counts, "bin", "left")
        .select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))
        .orderBy("bin")
    )


def mean_median(tables: Tables) -> DataFrame:
    """Mean and exact interpolated median of the stock level, from counts per level.

    The block of 65,536 levels that holds the middle is found first, then the level in
    it. Levels are 32-bit integers, so neither ordered step sees more rows than that per
    block or in blocks, however many rows and levels there are.

    A block is never NULL and says so, which keeps the join from adding a NULL filter to
    one of the two uses of the counts: alike, they share one scan and shuffle.
    """
    levels = _level_counts(tables).withColumn(
        "block", F.coalesce(F.shiftright("level", 16), F.lit(0))
    )
    blocks = levels.groupBy("block").agg(
        F.sum("n").alias("rows"), F.sum(F.col("level") * F.col("n")).alias("units")
    )
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    placed = blocks.select(
        "block",
        "rows",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("rows").over(everything).alias("row_total"),
        F.sum("units").over(everything).alias("unit_total"),
    )
    # Positions of the middle row, or of the middle two.
    lower = F.ceil(F.col("row_total") / 2)
    upper = F.floor(F.col("row_total") / 2) + 1
    middle = placed.filter(
        (F.col("rows_before") < upper) & (F.col("rows_before") + F.col("rows") >= lower)
    )
    up_to = Window.partitionBy("block").orderBy("level").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    reached = levels.join(middle, "block").withColumn(
        "reached", F.col("rows_before") + F.sum("n").over(up_to)
    )
    first = F.min(F.when(F.col("reached") >= lower, F.col("level")))
    second = F.min(F.when(F.col("reached") >= upper, F.col("level")))
    return reached.agg(
        F.max(ratio("unit_total", "row_total")).alias("mean"),
        ((as_double(first) + as_double(second)) / 2).alias("median"),
    )


def forecast_vs_actual(tables: Tables) -> DataFrame:
    """Daily sales and forecast with the relative error, NULL on a day without sales."""
    daily = (
        merged(fact_days(tables), ["txn_date"], "sold_sum", "planned_sum")
        .select(
            "txn_date",
            as_double("sold_sum").alias("sold"),
            as_double(from_cents("planned_sum")).alias("forecast"),
        )
    )
    error = percent(F.col("forecast") - F.col("sold"), "sold")
    return daily.withColumn("err_pct", error).orderBy("txn_date")


def forecast_error_pct(tables: Tables) -> DataFrame:
    return forecast_vs_actual(tables).select("txn_date", "err_pct")


def monthly_seasonality(tables: Tables) -> DataFrame:
    """Units per calendar month over all years."""
    return (
        fact_days(tables).groupBy(F.month("txn_date").alias("month"))
        .agg(F.sum("sold_sum").alias("units"))
        .select("month", month_label(F.col("month")).alias("m_label"), "units")
        .orderBy("month")
    )


def action_counts(tables: Tables, policy: ReorderPolicy = POLICY) -> DataFrame:
    """Pairs per advice, against unrounded levels."""
    action = advice(
        "on_hand",
        "reorder_at",
        "ceiling",
        F.lit(P.INCREASE),
        F.lit(P.DECREASE),
        F.lit(P.HOLD),
    )
    return (
        with_reorder_levels(pair_history(tables), policy)
        .groupBy(action.alias("action"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def complete_domain(counts: DataFrame, key: str, domain: tuple[str, ...]) -> DataFrame:
    """A row for every value of ``domain`` in its order, 0 where ``counts`` has none."""
    listed = counts.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(value) for value in domain])).alias("position", key)
    )
    return (
        listed.join(counts, key, "left")
        .orderBy("position")
        .select(key, F.coalesce("n", F.lit(0)).alias("n"))
    )


def complete_actions(tables: Tables) -> DataFrame:
    return complete_domain(action_counts(tables), "action", P.ACTIONS)


def store_performance(tables: Tables) -> DataFrame:
    return (
        fact_months(tables).groupBy("store_id")
        .agg(
            F.sum("sold_sum").alias("units"),
            F.sum(F.col("earned").cast(EXACT)).alias("earned"),
            F.sum("stock_sum").alias("stock_sum"),
            F.sum("stock_n").alias("stock_n"),
        )
        .select(
            "store_id",
            "units",
            as_double(from_cents("earned")).alias("revenue"),
            mean_of("stock").alias("avg_inv"),
        )
        .orderBy("store_id")
    )


# --- chart units: millions of money, thousands of pieces ------------------------------


def top_products_in_millions(tables: Tables) -> DataFrame:
    return top_products(tables).select(
        "product_id", (F.col("revenue") / 1e6).alias("revenue_m"), "abc"
    )


def monthly_in_thousands(tables: Tables) -> DataFrame:
    return monthly_seasonality(tables).select(
        "m_label", (as_double("units") / 1e3).alias("units_k")
    )


def stores_in_millions(tables: Tables) -> DataFrame:
    return store_performance(tables).select(
        "store_id", (F.col("revenue") / 1e6).alias("revenue_m"), "avg_inv"
    )
