"""The catalogue of analyses, and a batch run that writes each as a report."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfsight.model import Tables
from shelfsight.operators import dashboard as D
from shelfsight.operators import exploratory as E
from shelfsight.operators import loading as L
from shelfsight.operators import production as Q
from shelfsight.operators import quality as V
from shelfsight.operators import recommendations as R
from shelfsight.sources.csv_files import write_report
from shelfsight.workspace import exists, read_text, replace_text

Analysis = Callable[[Tables], DataFrame]

PRODUCTION: dict[str, Analysis] = {
    "q1_current_stock_levels": Q.current_stock_levels,
    "q2_low_inventory_alerts": Q.low_inventory_alerts,
    "q3_reorder_points": Q.reorder_points,
    "q4_turnover": Q.turnover,
    "q5_kpi_summary": Q.kpi_summary,
    "q6_abc_analysis": Q.abc_analysis,
    "q7_stock_adjustments": Q.stock_adjustments,
    "q8_supplier_performance": Q.supplier_performance,
    "q9_demand_forecast": Q.demand_forecast,
    "q10_stockout_by_category_region": Q.stockout_by_category_region,
}

EXPLORATORY: dict[str, Analysis] = {
    "e1_stock_levels": E.stock_levels,
    "e2_turnover_top": E.turnover_top,
    "e3_reorder_risk": E.reorder_risk,
    "e4_kpi_by_category": E.kpi_by_category,
    "e5_critical_by_category": E.critical_by_category,
    "e6_fast_vs_slow": E.fast_vs_slow,
    "e7_overstock": E.overstock,
    "e8_supply_gaps": E.supply_gaps,
    "e9_seasonality": E.seasonality,
    "e10_lost_revenue": E.lost_revenue,
    "e11_abc_percentile": E.abc_percentile,
}

DASHBOARD: dict[str, Analysis] = {
    "d1_kpi_cards": D.kpi_cards,
    "d2_daily_trend": D.daily_trend,
    "d3_abc": D.abc,
    "d4_category_sales": D.category_sales,
    "d5_heat": D.sales_heat,
    "d6_inventory_distribution": D.inventory_distribution,
    "d7_forecast_vs_actual": D.forecast_vs_actual,
    "d8_monthly_seasonality": D.monthly_seasonality,
    "d9_action_counts": D.action_counts,
    "d10_store_performance": D.store_performance,
}

DERIVED: dict[str, Analysis] = {
    "p1_rolling_mean": D.moving_means,
    "p2_forecast_error_pct": D.forecast_error_pct,
    "p3_pivot_category_region": D.pivot_category_region,
    "p4_pivot_abc": E.pivot_abc,
    "p5_complete_domain": D.complete_actions,
    "p6_histogram": D.histogram,
    "p7_mean_median": D.mean_median,
    "p8_top_products": D.top_products,
    "p9_revenue_mix": D.revenue_mix,
    "p10_high_risk": E.high_risk,
    "p11_fast_slow_extremes": E.fast_slow_extremes,
    "p12_season_label": E.season_label,
    "p13_top_products_millions": D.top_products_in_millions,
    "p13_monthly_thousands": D.monthly_in_thousands,
    "p13_stores_millions": D.stores_in_millions,
}

LOADING: dict[str, Analysis] = {
    "l2_staging_row_count": L.staging_row_count,
    "l3_dim_date": lambda t: t.dim_date,
    "l4_dim_product": lambda t: t.dim_product,
    "l5_dim_store": lambda t: t.dim_store,
    "l6_dim_region": lambda t: t.dim_region,
    "l7_fact": lambda t: t.table("fact_inventory_daily"),
    "l8_table_row_counts": L.table_row_counts,
    "l11_stores": L.flat_stores,
    "l11_products": L.flat_products,
    "l11_inventory_log": L.flat_inventory_log,
    "l12_profile": L.profile_staging,
    "l12_first_rows": L.first_rows,
}

QUALITY: dict[str, Analysis] = {
    "v1_fact_key_unique": V.fact_key_unique,
    "v2_dimension_keys_unique": V.dimension_keys_unique,
    "v3_foreign_keys": V.foreign_keys,
    "v4_value_ranges": V.value_ranges,
    "v5_nulls": V.nulls,
    "v6_text_lengths": V.text_lengths,
    "v7_dropped_rows": V.dropped_rows,
}

# Days of supply that some products of the sample tables fall below.
REGISTERED_DAYS = 8.7

RECOMMENDATIONS: dict[str, Analysis] = {
    "r1_trailing_velocity_gap": R.trailing_velocity_gap,
    "r2_critical_class_a": lambda t: R.critical_class_a(t, days=REGISTERED_DAYS),
    "r3_category_days_of_supply": R.category_days_of_supply,
}

CATALOGUE: dict[str, Analysis] = {
    **LOADING,
    **PRODUCTION,
    **EXPLORATORY,
    **DASHBOARD,
    **DERIVED,
    **QUALITY,
    **RECOMMENDATIONS,
}


@dataclass(frozen=True)
class Outcome:
    name: str
    rows: int | None
    error: str | None


#: Analyses with one row, or a row per category, day, month, action or the like: their report is a single file.
SINGLE_FILE = {
    "q5_kpi_summary", "q10_stockout_by_category_region", *(name for name in EXPLORATORY if name != "e6_fast_vs_slow"),
    "d1_kpi_cards", "d2_daily_trend", "d4_category_sales", "d5_heat", "d7_forecast_vs_actual", "d8_monthly_seasonality",
    "d9_action_counts", "p1_rolling_mean", "p2_forecast_error_pct", "p3_pivot_category_region", "p4_pivot_abc",
    "p5_complete_domain", "p6_histogram", "p7_mean_median", "p8_top_products", "p9_revenue_mix", "p10_high_risk",
    "p11_fast_slow_extremes", "p12_season_label", "p13_top_products_millions", "p13_monthly_thousands",
    "l2_staging_row_count", "l6_dim_region", "l8_table_row_counts", "l12_profile", "l12_first_rows",
    *QUALITY, "r3_category_days_of_supply",
}
RECORDS = "_finished"


def run_suite(
    tables: Tables,
    out: str,
    names: Iterable[str] = tuple(PRODUCTION),
    at_once: int = 4,
    resume: str | None = None,
) -> list[Outcome]:
    """Write each named analysis as CSV below ``out``; an error is noted and the run goes on.

    ``at_once`` reports are worked on side by side, each in a scheduler pool of its own name. A report whose rows are
    bounded by its meaning is one file ``<name>.csv``, any other a folder ``<name>`` of part files.

    With ``resume``, a name for the state of the tables such as their version, a record is written per finished
    report, and a later run with the same name leaves finished reports as they are. Outcomes come in order of ``names``.
    """
    spark, names = tables.fact.sparkSession, list(names)
    tables.as_of  # noqa: B018 - read once, not by every report at the same time

    def report(name: str) -> Outcome:
        record = f"{out}/{RECORDS}/{name}"
        try:
            if resume is not None and exists(spark, record):
                state, rows = json.loads(read_text(spark, record))
                if state == resume:
                    return Outcome(name, rows, None)
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            counted = Observation(name)
            result = CATALOGUE[name](tables).observe(counted, F.count(F.lit(1)).alias("rows"))
            write_report(result, f"{out}/{name}", name in SINGLE_FILE)
            rows = counted.get["rows"]
            if resume is not None:
                replace_text(spark, record, json.dumps([resume, rows]))
            return Outcome(name, rows, None)
        except Exception as error:  # noqa: BLE001 - one failing report must not end the run
            return Outcome(name, None, str(error) or type(error).__name__)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        # Wrapped anew for each report: a wrapper holds one copy of the caller's local properties.
        running = [pool.submit(inheritable_thread_target(spark)(report), name) for name in names]
        return [outcome.result() for outcome in running]
