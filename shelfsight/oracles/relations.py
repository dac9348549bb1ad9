"""Common table expressions the statements are built from."""

from __future__ import annotations

import re

RELATIONS = {
    "staging_inventory": """
        SELECT CAST(l_shipdate AS DATE) AS txn_date,
               n_name AS store_id,
               p_brand AS product_id,
               'CAT_' || (CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 5) AS category,
               r_name AS region,
               CAST((7 * sum(l_orderkey) + 13 * sum(l_partkey)) % 301 AS INTEGER) AS inventory_level,
               CAST(coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) AS INTEGER) AS units_sold,
               CAST(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS INTEGER) AS units_ordered,
               CAST(0.90 * CAST(sum(l_quantity) AS DECIMAL(18, 2)) + sum(l_orderkey) % 7
                    AS DECIMAL(10, 2)) AS demand_forecast,
               CAST(max(p_retailprice) AS DECIMAL(10, 2)) AS price,
               CAST(round(100 * max(l_discount)) AS INTEGER) AS discount,
               (['Sunny', 'Cloudy', 'Rainy', 'Snowy'])[CAST(sum(l_orderkey) % 4 AS BIGINT) + 1] AS weather_condition,
               CAST(max(l_discount) >= 0.08::DOUBLE AS SMALLINT) AS holiday_promotion,
               CAST(min(p_retailprice) AS DECIMAL(10, 2)) AS competitor_pricing,
               CASE WHEN month(txn_date) IN (12, 1, 2) THEN 'Winter'
                    WHEN month(txn_date) <= 5 THEN 'Spring'
                    WHEN month(txn_date) <= 8 THEN 'Summer'
                    ELSE 'Autumn' END AS seasonality
        FROM lineitem, part, supplier, nation, region
        WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey
          AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
        GROUP BY txn_date, n_name, p_brand, r_name""",
    "dim_date": """
        SELECT txn_date AS date_key,
               CAST(day(txn_date) AS SMALLINT) AS day,
               CAST(month(txn_date) AS SMALLINT) AS month,
               monthname(txn_date) AS month_name,
               CAST(quarter(txn_date) AS SMALLINT) AS quarter,
               CAST(year(txn_date) AS SMALLINT) AS year,
               CAST(isodow(txn_date) AS SMALLINT) AS day_of_week,
               dayname(txn_date) AS day_name,
               isodow(txn_date) > 5 AS is_weekend,
               seasonality AS season,
               CAST(weekofyear(txn_date) AS SMALLINT) AS week_of_year
        FROM staging_inventory GROUP BY ALL""",
    "dim_product": "SELECT product_id, category FROM staging_inventory GROUP BY ALL",
    "dim_store": "SELECT store_id FROM staging_inventory GROUP BY ALL",
    "dim_region": """
        SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY region) AS INTEGER) AS region_id,
               region AS region_name
        FROM staging_inventory""",
    "fact_inventory_daily": """
        SELECT txn_date, store_id, product_id, region_id, inventory_level, units_sold,
               units_ordered, demand_forecast, price, discount AS discount_pct,
               competitor_pricing AS competitor_price, weather_condition, holiday_promotion
        FROM staging_inventory, dim_region WHERE region = region_name""",
    "today": "SELECT max(txn_date) AS d FROM fact_inventory_daily",
    "shelf": """
        SELECT f.store_id, f.product_id, f.txn_date AS as_of_date, f.inventory_level AS on_hand
        FROM fact_inventory_daily f
        SEMI JOIN (SELECT store_id, product_id, max(txn_date) AS txn_date
                   FROM fact_inventory_daily GROUP BY ALL) newest
          USING (store_id, product_id, txn_date)""",
    "recent_30": """
        SELECT store_id, product_id, avg(units_sold) AS mu
        FROM fact_inventory_daily, today WHERE date_diff('day', txn_date, d) <= 30
        GROUP BY ALL""",
    "recent_90": """
        SELECT store_id, product_id, avg(units_sold) AS mu, stddev_samp(units_sold) AS sigma
        FROM fact_inventory_daily, today WHERE date_diff('day', txn_date, d) <= 90
        GROUP BY ALL""",
    "history": """
        SELECT store_id, product_id, avg(units_sold) AS mu, stddev_samp(units_sold) AS sigma,
               max(units_sold) AS peak
        FROM fact_inventory_daily GROUP BY ALL""",
    "levels_90": """
        SELECT *, mu * 7 AS cycle, 1.65::DOUBLE * sigma * sqrt(7) AS safety,
               mu * 7 + 1.65::DOUBLE * sigma * sqrt(7) AS rop
        FROM recent_90""",
    "levels": """
        SELECT *, mu * 7 AS cycle, 1.65::DOUBLE * sigma * sqrt(7) AS safety,
               mu * 7 + 1.65::DOUBLE * sigma * sqrt(7) AS rop,
               mu * 7 * 1.5::DOUBLE + 1.65::DOUBLE * sigma * sqrt(7) AS top
        FROM history""",
    "product_sales": """
        SELECT product_id, category, sum(units_sold) AS units, sum(units_sold * price) AS rev
        FROM fact_inventory_daily JOIN dim_product USING (product_id) GROUP BY ALL""",
    "shares": """
        SELECT a.product_id, a.category, a.units, a.rev,
               100.0::DOUBLE * CAST(a.rev AS DOUBLE) / CAST((SELECT sum(rev) FROM product_sales) AS DOUBLE)
                   AS pct,
               100.0::DOUBLE * CAST(sum(b.rev) AS DOUBLE)
                   / CAST((SELECT sum(rev) FROM product_sales) AS DOUBLE) AS cum
        FROM product_sales a
        JOIN product_sales b ON b.rev > a.rev OR (b.rev = a.rev AND (b.product_id, b.category) <= (a.product_id, a.category))
        GROUP BY a.product_id, a.category, a.units, a.rev""",
    "daily": """
        SELECT txn_date, sum(units_sold) AS units, sum(demand_forecast) AS planned,
               avg(inventory_level) AS stock
        FROM fact_inventory_daily GROUP BY txn_date""",
    "last_90": """
        SELECT f.* FROM fact_inventory_daily f, today WHERE date_diff('day', txn_date, d) <= 90""",
    "products": """
        SELECT product_id, category, price FROM staging_inventory
        QUALIFY row_number() OVER (PARTITION BY product_id
                                   ORDER BY txn_date, store_id, category, price) = 1""",
    "log": """
        SELECT s.*, p.category AS cat, p.price AS first_price
        FROM staging_inventory s JOIN products p ON p.product_id = s.product_id""",
    "per_product": """
        SELECT product_id, cat, first_price, avg(inventory_level) AS stock, avg(units_sold) AS pace,
               min(inventory_level) AS lowest, sum(units_sold) AS sold, sum(units_ordered) AS ordered,
               count(txn_date) AS days, count(*) FILTER (inventory_level <= 0) AS empty_days,
               count(*) FILTER (inventory_level <= 50) AS low_days,
               avg(units_sold) FILTER (inventory_level > 50) AS healthy_pace
        FROM log GROUP BY ALL""",
    "velocity": """
        SELECT cat, product_id, sold,
               rank() OVER (PARTITION BY cat ORDER BY sold DESC) AS from_top,
               rank() OVER (PARTITION BY cat ORDER BY sold) AS from_bottom
        FROM per_product""",
    "seasons": """
        SELECT seasonality, holiday_promotion, avg(units_sold) AS sold,
               CAST(sum(demand_forecast) AS DOUBLE) / count(demand_forecast) AS planned
        FROM staging_inventory GROUP BY ALL""",
    "valued": """
        SELECT product_id, cat, sold * first_price AS rev,
               percent_rank() OVER (ORDER BY sold * first_price DESC) AS pr
        FROM per_product""",
    "classes": """
        SELECT cat, CASE WHEN pr <= 0.20 THEN 'A-Class (Top 20%)'
                         WHEN pr <= 0.50 THEN 'B-Class (Next 30%)'
                         ELSE 'C-Class (Bottom 50%)' END AS cls,
               round(CAST(sum(rev) AS DOUBLE), 2) AS total
        FROM valued GROUP BY ALL""",
    "heat": """
        SELECT category, region_name, avg(units_sold) AS avg_sales
        FROM fact_inventory_daily JOIN dim_product USING (product_id)
        JOIN dim_region USING (region_id) GROUP BY ALL""",
    "advised": """
        SELECT CASE WHEN on_hand < rop THEN 'INCREASE' WHEN on_hand > top THEN 'DECREASE'
                    ELSE 'HOLD' END AS action
        FROM shelf JOIN levels USING (store_id, product_id)""",
}


def _mentions(text: str) -> list[str]:
    return [name for name in RELATIONS if re.search(rf"\b{name}\b", text)]


def with_relations(statement: str) -> str:
    """``statement`` preceded by the relations it mentions, directly or through others."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _mentions(RELATIONS[name]):
            if other != name and other not in ordered:
                add(other)
        if name not in ordered:
            ordered.append(name)

    for name in _mentions(statement):
        add(name)
    if not ordered:
        return statement
    parts = ",\n".join(f"{name} AS ({RELATIONS[name]})" for name in ordered)
    return f"WITH {parts}\n{statement}"
