"""One statement per registered query."""

from __future__ import annotations

from shelfsight.model import STAGING_COLUMNS, STAR_TABLES
# Fixed values in the statements below: class limits 70 and 90 percent of cumulative revenue (at or
# below 70 is A, at or below 90 is B, else C), and 0.20 and 0.50 of percent rank.
from shelfsight.oracles.relations import with_relations

LOADING = {
    "l2_staging_row_count": "SELECT count(*) AS staging_rows FROM staging_inventory",
    "l3_dim_date": "SELECT * FROM dim_date",
    "l4_dim_product": "SELECT * FROM dim_product",
    "l5_dim_store": "SELECT * FROM dim_store",
    "l6_dim_region": "SELECT * FROM dim_region",
    "l7_fact": "SELECT * FROM fact_inventory_daily",
    "l8_table_row_counts": "\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS rows FROM {name}" for name in STAR_TABLES
    ),
    "l11_stores": 'SELECT DISTINCT store_id AS "Store ID" FROM staging_inventory',
    "l11_products": """
        SELECT product_id AS "Product ID", category AS "Category", price AS "Price"
        FROM products""",
    "l11_inventory_log": """
        SELECT txn_date AS "Date", store_id AS "Store ID", product_id AS "Product ID",
               region AS "Region", inventory_level AS "Inventory Level",
               units_sold AS "Units Sold", units_ordered AS "Units Ordered",
               demand_forecast AS "Demand Forecast", discount AS "Discount",
               holiday_promotion AS "Holiday/Promotion",
               competitor_pricing AS "Competitor Pricing", seasonality AS "Seasonality"
        FROM staging_inventory""",
    "l12_profile": "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS column_name, "
        f"'{kind.simpleString()}' AS column_type, count({name}) AS non_null, "
        f"count(*) AS rows FROM staging_inventory"
        for i, (_, name, kind, _) in enumerate(STAGING_COLUMNS)
    ),
    "l12_first_rows": """
        SELECT * FROM staging_inventory ORDER BY txn_date, store_id, product_id LIMIT 5""",
}

PRODUCTION = {
    "q1_current_stock_levels": """
        SELECT store_id, product_id, category, as_of_date, on_hand,
               round(mu, 2) AS avg_daily_demand_30d,
               round(on_hand / nullif(mu, 0), 1) AS days_of_cover
        FROM shelf JOIN recent_30 USING (store_id, product_id)
        JOIN dim_product USING (product_id)""",
    "q2_low_inventory_alerts": """
        SELECT store_id, product_id, category, on_hand, round(cycle, 0) AS cycle_stock,
               round(safety, 0) AS safety_stock, round(rop, 0) AS reorder_point,
               if(on_hand = 0, 'STOCKOUT', 'REORDER NOW') AS status
        FROM shelf JOIN levels_90 USING (store_id, product_id)
        JOIN dim_product USING (product_id)
        WHERE on_hand <= rop""",
    "q3_reorder_points": """
        SELECT store_id, product_id, category, round(mu, 1) AS avg_daily_demand,
               round(sigma, 1) AS demand_std_dev, peak AS peak_demand,
               round(cycle, 0) AS cycle_stock, round(safety, 0) AS safety_stock,
               round(rop, 0) AS reorder_point, round(top, 0) AS max_stock_level
        FROM levels JOIN dim_product USING (product_id)""",
    "q4_turnover": """
        SELECT category, product_id, units AS total_units_sold, round(stock, 1) AS avg_inventory,
               round(turns, 2) AS turnover_ratio,
               round(365 / nullif(turns, 0), 1) AS days_inventory_outstanding
        FROM (SELECT category, product_id, CAST(sum(units_sold) AS BIGINT) AS units,
                     avg(inventory_level) AS stock,
                     CAST(sum(units_sold) AS DOUBLE) / nullif(avg(inventory_level), 0) AS turns
              FROM fact_inventory_daily JOIN dim_product USING (product_id), today
              WHERE date_diff('day', txn_date, d) <= 365 GROUP BY ALL)""",
    "q5_kpi_summary": """
        SELECT count(DISTINCT txn_date) AS days_in_window, count(*) AS fact_rows,
               CAST(sum(units_sold) AS BIGINT) AS total_units_sold,
               round(CAST(sum(units_sold * price) AS DOUBLE), 0) AS gross_revenue,
               round(avg(inventory_level), 1) AS avg_stock_level,
               round(100 * CAST(count(*) FILTER (inventory_level = 0) AS DOUBLE) / count(*), 2)
                   AS stockout_rate_pct,
               round(100 * CAST(count(*) FILTER (units_sold = 0) AS DOUBLE) / count(*), 2)
                   AS zero_sale_rate_pct,
               round(avg(CAST(inventory_level AS DOUBLE) / units_sold) FILTER (units_sold > 0), 1)
                   AS avg_days_of_cover,
               round(CAST(sum(units_sold) AS DOUBLE) / nullif(avg(inventory_level), 0), 2)
                   AS turnover_90d,
               round(100 * CAST(count(*) FILTER (units_sold > demand_forecast) AS DOUBLE)
                     / count(*), 2) AS forecast_under_pct
        FROM last_90""",
    "q6_abc_analysis": """
        SELECT product_id, category, CAST(units AS BIGINT) AS units_sold,
               CAST(rev AS DOUBLE) AS revenue, round(pct, 2) AS pct_of_revenue,
               round(cum, 2) AS cumulative_pct,
               CASE WHEN cum <= 70 THEN 'A - Fast Mover' WHEN cum <= 90 THEN 'B - Medium Mover'
                    ELSE 'C - Slow Mover' END AS abc_class
        FROM shares""",
    "q7_stock_adjustments": """
        SELECT store_id, product_id, on_hand, low AS reorder_point, high AS target_max,
               CASE WHEN on_hand < low THEN 'INCREASE' WHEN on_hand > high THEN 'DECREASE'
                    ELSE 'HOLD' END AS action,
               CASE WHEN on_hand < low OR on_hand > high THEN abs(high - on_hand)
                    ELSE 0 END AS units_to_adjust
        FROM (SELECT store_id, product_id, on_hand, round(rop, 0) AS low, round(top, 0) AS high
              FROM shelf JOIN levels USING (store_id, product_id))""",
    "q8_supplier_performance": """
        SELECT product_id, category, count(*) AS observation_days,
               round(avg(units_ordered), 1) AS avg_units_ordered,
               round(avg(units_sold), 1) AS avg_units_sold,
               round(CAST(sum(demand_forecast) AS DOUBLE) / count(*), 1) AS avg_forecast,
               round(avg(CAST(units_sold AS DOUBLE) / units_ordered) FILTER (units_ordered <> 0), 3)
                   AS fill_rate_proxy,
               round(stddev_samp(units_ordered), 1) AS order_variability,
               round(CAST(sum(abs(units_ordered - demand_forecast)) AS DOUBLE) / count(*), 1)
                   AS order_vs_forecast_mae
        FROM fact_inventory_daily JOIN dim_product USING (product_id) GROUP BY ALL""",
    "q9_demand_forecast": """
        SELECT product_id, txn_date, CAST(u AS BIGINT) AS units_sold, CAST(fc AS DOUBLE) AS forecast,
               round(avg(u) OVER (s ROWS 6 PRECEDING), 1) AS ma_7d,
               round(avg(u) OVER (s ROWS 29 PRECEDING), 1) AS ma_30d,
               round(100 * CAST(u - lag(u, 7) OVER s AS DOUBLE) / nullif(lag(u, 7) OVER s, 0), 1)
                   AS wow_growth_pct
        FROM (SELECT product_id, txn_date, sum(units_sold) AS u, sum(demand_forecast) AS fc
              FROM fact_inventory_daily, today
              WHERE date_diff('day', txn_date, d) <= 60 GROUP BY ALL)
        WINDOW s AS (PARTITION BY product_id ORDER BY txn_date)""",
    "q10_stockout_by_category_region": """
        SELECT category, region_name, count(*) AS fact_rows,
               count(*) FILTER (inventory_level = 0) AS stockout_days,
               round(100 * CAST(count(*) FILTER (inventory_level = 0) AS DOUBLE) / count(*), 3)
                   AS stockout_rate_pct,
               round(avg(inventory_level), 1) AS avg_inventory,
               round(avg(units_sold), 1) AS avg_daily_sales
        FROM fact_inventory_daily JOIN dim_product USING (product_id)
        JOIN dim_region USING (region_id) GROUP BY ALL""",
}

EXPLORATORY = {
    "e1_stock_levels": """
        SELECT cat AS "Category", product_id AS "Product ID", region AS "Region",
               CAST(sum(inventory_level) AS BIGINT) AS "Total_Current_Stock",
               avg(inventory_level) AS "Avg_Daily_Stock"
        FROM log GROUP BY ALL
        ORDER BY "Total_Current_Stock" DESC, "Category", "Product ID", "Region" LIMIT 10""",
    "e2_turnover_top": """
        SELECT product_id AS "Product ID", CAST(sum(units_sold) AS BIGINT) AS "Total_Sold",
               avg(inventory_level) AS "Avg_Inventory",
               coalesce(CAST(sum(units_sold) AS DOUBLE) / nullif(avg(inventory_level), 0), 0)
                   AS "Inventory_Turnover_Ratio"
        FROM staging_inventory GROUP BY product_id
        ORDER BY "Inventory_Turnover_Ratio" DESC, product_id LIMIT 10""",
    "e3_reorder_risk": """
        SELECT product_id AS "Product ID", cat AS "Category", round(pace, 2) AS "Avg_Daily_Sales",
               round(pace * 7, 2) AS "Est_Reorder_Point", lowest AS "Current_Min_Inventory",
               if(lowest < pace * 7, 'High Risk', 'Healthy') AS "Stockout_Risk"
        FROM per_product ORDER BY pace DESC, product_id LIMIT 10""",
    "e4_kpi_by_category": """
        SELECT cat AS "Category", count(*) AS "Total_SKUs_in_Category",
               round(avg(stock), 0) AS "Average_Stock_Level",
               CAST(sum(sold) AS BIGINT) AS "Total_Units_Sold",
               round(CAST(sum(empty_days) AS DOUBLE) / sum(days) * 100, 2)
                   AS "Stockout_Rate_Percent"
        FROM per_product GROUP BY cat""",
    "e5_critical_by_category": """
        SELECT cat AS "Category", count(*) AS "Total_SKUs_in_Category",
               round(avg(stock), 0) AS "Average_Stock_Level",
               CAST(sum(sold) AS BIGINT) AS "Total_Units_Sold",
               round(CAST(sum(low_days) AS DOUBLE) / sum(days) * 100, 2)
                   AS "Critical_Stock_Rate_Percent"
        FROM per_product GROUP BY cat""",
    "e6_fast_vs_slow": """
        SELECT cat AS "Category", product_id AS "Product ID",
               CAST(sold AS BIGINT) AS "Total_Units_Sold",
               if(from_top <= 2, 'Fast-Selling', 'Slow-Moving') AS "Product_Velocity_Status"
        FROM velocity WHERE least(from_top, from_bottom) <= 2""",
    "e7_overstock": """
        SELECT product_id AS "Product ID", cat AS "Category",
               round(stock, 1) AS "Avg_Inventory_On_Hand", round(pace, 1) AS "Avg_Daily_Sales",
               round(stock / nullif(pace, 0), 1) AS "Days_Of_Supply",
               CASE WHEN stock / nullif(pace, 0) > 30 THEN 'Reduce Stock / Holding Cost Risk'
                    WHEN stock / nullif(pace, 0) < 7 THEN 'Increase Stock / Stockout Risk'
                    ELSE 'Optimal' END AS "Recommended_Action"
        FROM per_product ORDER BY "Days_Of_Supply" DESC NULLS LAST, product_id LIMIT 10""",
    "e8_supply_gaps": """
        SELECT product_id AS "Product ID", CAST(ordered AS BIGINT) AS "Total_Units_Ordered",
               CAST(sold AS BIGINT) AS "Total_Units_Sold",
               CAST(ordered - sold AS BIGINT) AS "Net_Supply_Variance",
               round(stock, 1) AS "Avg_Daily_Inventory"
        FROM per_product ORDER BY ordered - sold, product_id LIMIT 10""",
    "e9_seasonality": """
        SELECT seasonality AS "Seasonality", holiday_promotion AS "Holiday/Promotion",
               round(sold, 2) AS "Avg_Units_Sold", round(planned, 2) AS "Avg_Forecasted_Demand",
               round(sold - planned, 2) AS "Forecast_Error"
        FROM seasons""",
    "e10_lost_revenue": """
        SELECT cat AS "Category",
               round(sum(low_days * healthy_pace * CAST(first_price AS DOUBLE)), 2)
                   AS "Estimated_Lost_Revenue"
        FROM per_product WHERE low_days > 0 AND healthy_pace IS NOT NULL GROUP BY cat""",
    "e11_abc_percentile": """
        SELECT cat AS "Category", cls AS "ABC_Classification", total AS "Total_Category_Revenue"
        FROM classes""",
}

DASHBOARD = {
    "d1_kpi_cards": """
        SELECT CAST(sum(units_sold) AS BIGINT) AS units_sold,
               CAST(sum(units_sold * price) AS DOUBLE) AS revenue,
               avg(inventory_level) AS avg_stock,
               100 * CAST(count(*) FILTER (inventory_level = 0) AS DOUBLE) / count(*) AS stockout_pct,
               CAST(sum(units_sold) AS DOUBLE) / nullif(avg(inventory_level), 0) AS turnover
        FROM last_90""",
    "d2_daily_trend": """
        SELECT txn_date, CAST(units AS BIGINT) AS units_sold, CAST(planned AS DOUBLE) AS forecast,
               stock AS avg_inv, avg(units) OVER (ORDER BY txn_date ROWS 6 PRECEDING) AS ma_7,
               avg(units) OVER (ORDER BY txn_date ROWS 29 PRECEDING) AS ma_30
        FROM daily""",
    "d3_abc": """
        SELECT product_id, category, CAST(units AS BIGINT) AS units_sold,
               CAST(rev AS DOUBLE) AS revenue, pct, cum AS cum_pct,
               CASE WHEN cum <= 70 THEN 'A' WHEN cum <= 90 THEN 'B' ELSE 'C' END AS abc
        FROM shares""",
    "d4_category_sales": """
        SELECT category, CAST(sum(rev) AS DOUBLE) AS revenue, CAST(sum(units) AS BIGINT) AS units
        FROM product_sales GROUP BY category""",
    "d5_heat": "SELECT * FROM heat",
    "d6_inventory_distribution": "SELECT inventory_level FROM fact_inventory_daily",
    "d7_forecast_vs_actual": """
        SELECT txn_date, CAST(units AS DOUBLE) AS sold, CAST(planned AS DOUBLE) AS forecast,
               100 * (CAST(planned AS DOUBLE) - CAST(units AS DOUBLE))
                   / nullif(CAST(units AS DOUBLE), 0) AS err_pct
        FROM daily""",
    "d8_monthly_seasonality": """
        SELECT CAST(month(txn_date) AS INTEGER) AS month, strftime(min(txn_date), '%b') AS m_label,
               CAST(sum(units_sold) AS BIGINT) AS units
        FROM fact_inventory_daily GROUP BY month(txn_date)""",
    "d9_action_counts": "SELECT action, count(*) AS n FROM advised GROUP BY action",
    "d10_store_performance": """
        SELECT store_id, CAST(sum(units_sold) AS BIGINT) AS units,
               CAST(sum(units_sold * price) AS DOUBLE) AS revenue, avg(inventory_level) AS avg_inv
        FROM fact_inventory_daily GROUP BY store_id""",
}

DERIVED = {
    "p1_rolling_mean": """
        SELECT txn_date, CAST(units AS BIGINT) AS units_sold,
               avg(units) OVER (ORDER BY txn_date ROWS 6 PRECEDING) AS ma_7,
               avg(units) OVER (ORDER BY txn_date ROWS 29 PRECEDING) AS ma_30
        FROM daily""",
    "p2_forecast_error_pct": """
        SELECT txn_date, 100 * (CAST(planned AS DOUBLE) - CAST(units AS DOUBLE))
               / nullif(CAST(units AS DOUBLE), 0) AS err_pct
        FROM daily""",
    "p3_pivot_category_region": """
        SELECT category, max(avg_sales) FILTER (region_name = 'AFRICA') AS "AFRICA",
               max(avg_sales) FILTER (region_name = 'AMERICA') AS "AMERICA",
               max(avg_sales) FILTER (region_name = 'ASIA') AS "ASIA",
               max(avg_sales) FILTER (region_name = 'EUROPE') AS "EUROPE",
               max(avg_sales) FILTER (region_name = 'MIDDLE EAST') AS "MIDDLE EAST"
        FROM heat GROUP BY category""",
    "p4_pivot_abc": """
        SELECT cat AS "Category",
               coalesce(max(total) FILTER (cls[1] = 'A'), 0) AS "A-Class (Top 20%)",
               coalesce(max(total) FILTER (cls[1] = 'B'), 0) AS "B-Class (Next 30%)",
               coalesce(max(total) FILTER (cls[1] = 'C'), 0) AS "C-Class (Bottom 50%)"
        FROM classes GROUP BY cat""",
    "p5_complete_domain": """
        SELECT a AS action, (SELECT count(*) FROM advised WHERE action = a) AS n
        FROM (VALUES ('INCREASE'), ('HOLD'), ('DECREASE')) AS v(a)""",
    "p6_histogram": """
        SELECT CAST(b.i AS INTEGER) AS bin, e.lo + b.i * ((e.hi - e.lo) / 40) AS lower,
               e.lo + (b.i + 1) * ((e.hi - e.lo) / 40) AS upper,
               (SELECT count(*) FROM fact_inventory_daily
                WHERE 40 * (inventory_level - e.lo) >= b.i * (e.hi - e.lo)
                  AND (40 * (inventory_level - e.lo) < (b.i + 1) * (e.hi - e.lo)
                       OR (b.i = 39 AND inventory_level = e.hi))) AS n
        FROM range(40) AS b(i),
             (SELECT CAST(min(inventory_level) AS DOUBLE) AS lo,
                     CAST(max(inventory_level) AS DOUBLE) AS hi FROM fact_inventory_daily) e""",
    "p7_mean_median": """
        SELECT avg(inventory_level) AS mean, CAST(median(inventory_level) AS DOUBLE) AS median
        FROM fact_inventory_daily""",
    "p8_top_products": """
        SELECT product_id, category, CAST(rev AS DOUBLE) AS revenue,
               CASE WHEN cum <= 70 THEN 'A' WHEN cum <= 90 THEN 'B' ELSE 'C' END AS abc
        FROM shares ORDER BY rev DESC, product_id LIMIT 15""",
    "p9_revenue_mix": """
        SELECT category, CAST(sum(rev) AS DOUBLE) AS revenue,
               round(100 * CAST(sum(rev) AS DOUBLE)
                     / CAST((SELECT sum(rev) FROM product_sales) AS DOUBLE), 1) AS share_pct
        FROM product_sales GROUP BY category""",
    "p10_high_risk": """
        SELECT product_id AS "Product ID", cat AS "Category", round(pace, 2) AS "Avg_Daily_Sales",
               round(pace * 7, 2) AS "Est_Reorder_Point", lowest AS "Current_Min_Inventory",
               'High Risk' AS "Stockout_Risk"
        FROM (SELECT * FROM per_product ORDER BY pace DESC, product_id LIMIT 10)
        WHERE lowest < pace * 7""",
    "p11_fast_slow_extremes": """
        SELECT cat AS "Category", product_id AS "Product ID",
               CAST(sold AS BIGINT) AS "Total_Units_Sold",
               if(from_top <= 2, 'Fast-Selling', 'Slow-Moving') AS "Product_Velocity_Status"
        FROM (SELECT *, row_number() OVER (ORDER BY cat, sold DESC, product_id) AS i,
                     count(*) OVER () AS m
              FROM velocity WHERE least(from_top, from_bottom) <= 2), range(2) AS twice(part)
        WHERE (part = 0 AND i <= 5) OR (part = 1 AND i > m - 5)""",
    "p12_season_label": """
        SELECT seasonality || ' (Promo: ' || holiday_promotion || ')' AS "Season_Label",
               round(sold, 2) AS "Avg_Units_Sold", round(planned, 2) AS "Avg_Forecasted_Demand"
        FROM seasons""",
    "p13_top_products_millions": """
        SELECT product_id, CAST(rev AS DOUBLE) / 1000000 AS revenue_m,
               CASE WHEN cum <= 70 THEN 'A' WHEN cum <= 90 THEN 'B' ELSE 'C' END AS abc
        FROM shares ORDER BY rev DESC, product_id LIMIT 15""",
    "p13_monthly_thousands": """
        SELECT strftime(min(txn_date), '%b') AS m_label,
               CAST(sum(units_sold) AS DOUBLE) / 1000 AS units_k
        FROM fact_inventory_daily GROUP BY month(txn_date)""",
    "p13_stores_millions": """
        SELECT store_id, CAST(sum(units_sold * price) AS DOUBLE) / 1000000 AS revenue_m,
               avg(inventory_level) AS avg_inv
        FROM fact_inventory_daily GROUP BY store_id""",
}


def _repeated(table: str, *key: str) -> str:
    columns = ", ".join(key)
    return (
        f"SELECT '{table}({columns})' AS \"check\", count(*) AS violations FROM "
        f"(SELECT 1 FROM {table} GROUP BY {columns} HAVING count(*) > 1)"
    )


def _orphans(column: str, table: str, key: str) -> str:
    return (
        f"SELECT '{column} -> {table}.{key}' AS \"check\", count(*) AS violations "
        f"FROM fact_inventory_daily WHERE {column} IS NOT NULL "
        f"AND {column} NOT IN (SELECT {key} FROM {table})"
    )


def _offending(name: str, table: str, condition: str) -> str:
    return (
        f"SELECT '{name}' AS \"check\", count(*) AS violations FROM {table} WHERE {condition}"
    )


# Columns of each table, and longest text allowed. Stated here once more, so that
# a wrong list in the library shows as a difference.
COLUMNS = {
    "staging_inventory": "txn_date store_id product_id category region inventory_level units_sold "
    "units_ordered demand_forecast price discount weather_condition holiday_promotion "
    "competitor_pricing seasonality",
    "fact_inventory_daily": "txn_date store_id product_id region_id inventory_level units_sold "
    "units_ordered demand_forecast price discount_pct competitor_price weather_condition "
    "holiday_promotion",
    "dim_date": "date_key day month month_name quarter year day_of_week day_name is_weekend season "
    "week_of_year",
    "dim_product": "product_id category",
    "dim_store": "store_id",
    "dim_region": "region_id region_name",
}
LIMITS = (
    ("staging_inventory", "store_id", 10),
    ("staging_inventory", "product_id", 10),
    ("staging_inventory", "category", 50),
    ("staging_inventory", "region", 20),
    ("staging_inventory", "weather_condition", 20),
    ("staging_inventory", "seasonality", 20),
    ("dim_date", "month_name", 10),
    ("dim_date", "day_name", 10),
    ("dim_date", "season", 20),
    ("dim_product", "product_id", 10),
    ("dim_product", "category", 50),
    ("dim_store", "store_id", 10),
    ("dim_region", "region_name", 20),
    ("fact_inventory_daily", "store_id", 10),
    ("fact_inventory_daily", "product_id", 10),
    ("fact_inventory_daily", "weather_condition", 20),
)

QUALITY = {
    "v1_fact_key_unique": _repeated("fact_inventory_daily", "txn_date", "store_id", "product_id"),
    "v2_dimension_keys_unique": "\nUNION ALL ".join(
        [
            _repeated("dim_date", "date_key"),
            _repeated("dim_product", "product_id"),
            _repeated("dim_store", "store_id"),
            _repeated("dim_region", "region_id"),
            _repeated("dim_region", "region_name"),
        ]
    ),
    "v3_foreign_keys": "\nUNION ALL ".join(
        [
            _orphans("txn_date", "dim_date", "date_key"),
            _orphans("store_id", "dim_store", "store_id"),
            _orphans("product_id", "dim_product", "product_id"),
            _orphans("region_id", "dim_region", "region_id"),
        ]
    ),
    "v4_value_ranges": "\nUNION ALL ".join(
        [
            _offending("inventory_level >= 0", "fact_inventory_daily", "inventory_level < 0"),
            _offending("units_sold >= 0", "fact_inventory_daily", "units_sold < 0"),
            _offending(
                "discount_pct in 0..100",
                "fact_inventory_daily",
                "NOT discount_pct BETWEEN 0 AND 100",
            ),
        ]
    ),
    "v5_nulls": "\nUNION ALL ".join(
        _offending(f"{table}.{column}", table, f"{column} IS NULL")
        for table, columns in COLUMNS.items()
        for column in columns.split()
    ),
    "v7_dropped_rows": """
        SELECT 'staging rows without a region' AS "check",
               (SELECT count(*) FROM staging_inventory) - (SELECT count(*) FROM fact_inventory_daily)
                   AS violations""",
    "v6_text_lengths": "\nUNION ALL ".join(
        _offending(f"{table}.{column} <= {limit}", table, f"length({column}) > {limit}")
        for table, column, limit in LIMITS
    ),
}

RECOMMENDATIONS = {
    "r1_trailing_velocity_gap": """
        SELECT store_id, product_id, CAST(sum(units_ordered) AS BIGINT) AS units_ordered,
               CAST(sum(units_sold) AS BIGINT) AS units_sold,
               round(avg(units_sold), 2) AS avg_daily_sales,
               CAST(sum(units_sold) - sum(units_ordered) AS BIGINT) AS shortfall
        FROM fact_inventory_daily, today WHERE date_diff('day', txn_date, d) <= 7
        GROUP BY store_id, product_id HAVING sum(units_sold) > sum(units_ordered)""",
    "r2_critical_class_a": """
        SELECT product_id, cat AS category, CAST(sold * first_price AS DOUBLE) AS revenue,
               round(stock / nullif(pace, 0), 2) AS days_of_supply
        FROM (SELECT *, percent_rank() OVER (ORDER BY sold * first_price DESC NULLS LAST) AS place
              FROM per_product)
        WHERE place <= 0.20 AND stock / nullif(pace, 0) < 8.7""",
    "r3_category_days_of_supply": """
        SELECT category, round(avg(inventory_level), 1) AS avg_inventory,
               round(avg(units_sold), 1) AS avg_daily_sales,
               round(avg(inventory_level) / nullif(avg(units_sold), 0), 2) AS days_of_supply
        FROM fact_inventory_daily JOIN dim_product USING (product_id) GROUP BY category""",
}

ORACLES: dict[str, str] = {
    name: with_relations(statement.strip())
    for group in (
        LOADING,
        PRODUCTION,
        EXPLORATORY,
        DASHBOARD,
        DERIVED,
        QUALITY,
        RECOMMENDATIONS,
    )
    for name, statement in group.items()
}
