"""Plan shapes that keep the analyses affordable on large tables."""

from __future__ import annotations

import pathlib
import re

import pytest

import __spark_entry__ as driver
from shelfsight.suite import CATALOGUE, DASHBOARD, EXPLORATORY, PRODUCTION

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SMALL).exists(), reason="sample tables absent")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return driver.tables_for(spark, SMALL)


@pytest.mark.parametrize("name", ["q1_current_stock_levels", "q2_low_inventory_alerts", "q4_turnover",
                                  "q9_demand_forecast", "r1_trailing_velocity_gap"])
def test_window_reaches_the_scan(spark, name):
    text = plan(driver.queries()[name](spark, SMALL))
    assert re.search(r"PartitionFilters: \[[^\]]*txn_month[^\]]*>=", text)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(txn_date", text)


@pytest.mark.parametrize("name", CATALOGUE)
def test_no_python_and_no_nested_loops(spark, name):
    physical = plan(driver.queries()[name](spark, SMALL)).split("== Physical Plan ==")[1]
    for node in ("PythonUDF", "ArrowEval", "BatchEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in physical, node


@pytest.mark.parametrize("name", ["q5_kpi_summary", "d1_kpi_cards"])
def test_window_of_days_reaches_the_scan(spark, name):
    text = plan(driver.queries()[name](spark, SMALL))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(txn_date", text)


def scans(df, column) -> list[str]:
    physical = plan(df).split("== Physical Plan ==")[1]
    return [line for line in physical.splitlines() if "FileScan" in line and re.search(rf"\b{column}\b", line)]


WINDOWED = {"q1_current_stock_levels", "q2_low_inventory_alerts", "q4_turnover", "q9_demand_forecast"}
ON_SUMMARIES = [n for n in (*PRODUCTION, *EXPLORATORY, *DASHBOARD) if n not in WINDOWED | {"d6_inventory_distribution"}]


@pytest.mark.parametrize("name", ON_SUMMARIES)
def test_daily_rows_are_not_read_again(spark, name):
    df = driver.queries()[name](spark, SMALL)
    files = {path.split("/")[-2] for path in df.inputFiles()} | {path.split("/")[-3] for path in df.inputFiles()}
    assert not files & {"fact_inventory_daily", "staging_inventory"}
    assert files & {"pair_months", "day_totals"} or "ranges-" in " ".join(df.inputFiles())


def test_windows_scan_the_fact_once(spark):
    assert len(scans(driver.queries()["q2_low_inventory_alerts"](spark, SMALL), "units_sold")) == 1


def test_foreign_keys_scan_the_fact_once(spark):
    assert len(scans(driver.queries()["v3_foreign_keys"](spark, SMALL), "region_id")) == 2  # fact and dim_region


def test_repeated_keys_shuffle_hashes(spark, tables):
    from shelfsight.operators.quality import FACT_KEY, suspected_rows

    physical = plan(suspected_rows(tables.fact, FACT_KEY)).split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin" in physical and not re.search(r"Exchange hashpartitioning\([^\n]*store_id", physical)


@pytest.mark.parametrize("name", ["l2_staging_row_count", "l8_table_row_counts"])
def test_counts_read_no_column(spark, name):
    physical = plan(driver.queries()[name](spark, SMALL)).split("== Physical Plan ==")[1]
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", physical)
    assert schemas and set(schemas) == {""}


@pytest.mark.parametrize("name", ["q3_reorder_points", "q7_stock_adjustments", "e6_fast_vs_slow", "q4_turnover"])
def test_no_single_partition(spark, name):
    physical = plan(driver.queries()[name](spark, SMALL)).split("== Physical Plan ==")[1]
    assert "Exchange SinglePartition" not in physical


def test_pairs_use_hash_aggregation(tables):
    from shelfsight.plans.cores import pair_stats

    physical = plan(pair_stats(tables.fact)).split("== Physical Plan ==")[1]
    assert "SortAggregate" not in physical and "ObjectHashAggregate" not in physical


@pytest.mark.parametrize("name", ["p6_histogram", "p7_mean_median"])
def test_level_counts_are_shared(spark, name):
    df = driver.queries()[name](spark, SMALL)
    df.collect()
    executed = df._jdf.queryExecution().executedPlan().toString()
    # Only plans that ran carry the number of their generated code; a reused exchange has nothing below it.
    assert len(re.findall(r"\*\(\d+\) ColumnarToRow", executed)) == 1 and "ReusedExchange" in executed


def test_first_seen_products_shuffle_one_row_per_product_and_task(spark, tables):
    from shelfsight.operators.loading import first_seen_products

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        physical = plan(first_seen_products(tables.staging)).split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert physical.count("Exchange") == 1 and "Join" not in physical and physical.count("FileScan") == 1
    assert re.search(r"Exchange.*\n.*Aggregate\(.*partial_min", physical)
