from __future__ import annotations

import random

import pandas as pd
import pytest
from conftest import day, records

from shelfsight.operators import exploratory as E


def totals(star, units: dict[str, int], category="Toys"):
    return star([{"product_id": p, "category": category, "units_sold": n} for p, n in units.items()])


def test_stock_levels_sum_over_days(star):
    tables = star([{"txn_date": day(i), "product_id": p, "inventory_level": n}
                   for i in range(2) for p, n in (("P1", 5), ("P2", 9))])
    assert [tuple(r.values()) for r in records(E.stock_levels(tables, limit=1))] == [
        ("Toys", "P2", "North", 18, 9.0)]


def test_turnover_of_empty_shelves_is_zero(star):
    tables = star([{"inventory_level": 0}, {"product_id": "P2", "inventory_level": 4, "units_sold": 2}])
    got = {r["Product ID"]: r["Inventory_Turnover_Ratio"] for r in records(E.turnover_top(tables))}
    assert got == {"P1": 0.0, "P2": 0.5}


def test_reorder_risk(star):
    tables = star([{"inventory_level": 69}, {"product_id": "P2", "inventory_level": 70}])
    got = {r["Product ID"]: r["Stockout_Risk"] for r in records(E.reorder_risk(tables))}
    assert got == {"P1": "High Risk", "P2": "Healthy"}
    assert [r["Product ID"] for r in records(E.high_risk(tables))] == ["P1"]


def test_category_mean_is_unweighted(star):
    tables = star([{"txn_date": day(i), "inventory_level": 0} for i in range(3)]
                  + [{"product_id": "P2", "inventory_level": 50}])
    row = records(E.kpi_by_category(tables))[0]
    assert (row["Total_SKUs_in_Category"], row["Average_Stock_Level"], row["Stockout_Rate_Percent"]) == (2, 25.0, 75.0)
    assert records(E.critical_by_category(tables))[0]["Critical_Stock_Rate_Percent"] == 100.0


@pytest.mark.parametrize("units, expected", [
    ({"P1": 9, "P2": 5, "P3": 1}, {"P1": "F", "P2": "F", "P3": "S"}),
    ({"P1": 9}, {"P1": "F"}),
    ({f"P{i}": i for i in range(6)}, {"P5": "F", "P4": "F", "P0": "S", "P1": "S"}),
    ({"P1": 9, "P2": 9, "P3": 9, "P4": 1}, {"P1": "F", "P2": "F", "P3": "F", "P4": "S"}),
    ({"P1": 9, "P2": 8, "P3": 8, "P4": 7, "P5": 0, "P6": 0}, {"P1": "F", "P2": "F", "P3": "F", "P5": "S", "P6": "S"}),
])
def test_fast_and_slow(star, units, expected):
    got = {r["Product ID"]: r["Product_Velocity_Status"][0] for r in records(E.fast_vs_slow(totals(star, units)))}
    assert got == expected


@pytest.mark.parametrize("k", [1, 2, 5])
def test_fast_and_slow_against_pandas_ranks(star, k):
    rng = random.Random(k)
    rows = [{"product_id": f"P{i}", "category": f"C{i % 4}", "units_sold": rng.randint(0, 6)} for i in range(80)]
    frame = pd.DataFrame(rows)
    by = frame.groupby("category").units_sold
    fast, slow = by.rank(method="min", ascending=False) <= k, by.rank(method="min") <= k
    expected = {p: "Fast-Selling" if f else "Slow-Moving" for p, f, s in zip(frame.product_id, fast, slow) if f or s}
    got = {r["Product ID"]: r["Product_Velocity_Status"] for r in records(E.fast_vs_slow(star(rows), k))}
    assert got == expected


def test_extremes_repeat_rows_of_a_short_list(star):
    tables = totals(star, {"P1": 9, "P2": 5, "P3": 1})
    assert sorted(r["Product ID"] for r in records(E.fast_slow_extremes(tables))) == ["P1", "P1", "P2", "P2", "P3", "P3"]
    assert [r["Product ID"] for r in records(E.fast_slow_extremes(tables, n=1))] == ["P1", "P3"]


def test_overstock(star):
    stock = {"P1": (310, 10), "P2": (300, 10), "P3": (69, 10), "P4": (5, 0)}
    tables = star([{"product_id": p, "inventory_level": i, "units_sold": n} for p, (i, n) in stock.items()])
    got = {r["Product ID"]: (r["Days_Of_Supply"], r["Recommended_Action"].split()[0]) for r in records(E.overstock(tables))}
    assert got == {"P1": (31.0, "Reduce"), "P2": (30.0, "Optimal"), "P3": (6.9, "Increase"), "P4": (None, "Optimal")}


def test_supply_gaps(star):
    tables = star([{"product_id": p, "units_ordered": o, "units_sold": 5} for p, o in (("P1", 9), ("P2", 1))])
    assert [(r["Product ID"], r["Net_Supply_Variance"]) for r in records(E.supply_gaps(tables))] == [("P2", -4), ("P1", 4)]


def test_seasonality_and_label(star):
    tables = star([{"units_sold": 4, "demand_forecast": 1.25}, {"store_id": "S2", "units_sold": 3, "demand_forecast": 2},
                   {"store_id": "S3", "holiday_promotion": 1}])
    assert [tuple(r.values()) for r in records(E.seasonality(tables))] == [
        ("Winter", 1, 10.0, 10.0, 0.0), ("Winter", 0, 3.5, 1.63, 1.88)]
    assert [r["Season_Label"] for r in records(E.season_label(tables))] == ["Winter (Promo: 1)", "Winter (Promo: 0)"]


def test_lost_revenue_uses_the_first_price_and_needs_both_sides(star):
    tables = star([
        {"txn_date": day(0), "inventory_level": 51, "units_sold": 4, "price": 2},
        {"txn_date": day(1), "inventory_level": 80, "units_sold": 6, "price": 100},
        {"txn_date": day(2), "inventory_level": 50, "units_sold": 1, "price": 100},
        {"txn_date": day(3), "inventory_level": 0, "units_sold": 0, "price": 100},
        {"product_id": "P2", "category": "Always full", "inventory_level": 60},
        {"product_id": "P3", "category": "Always low", "inventory_level": 1},
    ])
    assert records(E.lost_revenue(tables)) == [{"Category": "Toys", "Estimated_Lost_Revenue": 20.0}]


def test_percentile_classes(star):
    rows = [{"product_id": f"P{i}", "units_sold": 100 - i, "price": 1} for i in range(11)]
    rows.append({"product_id": "P0", "txn_date": day(1), "units_sold": 0, "price": 9999})  # later price: unused
    tables = star(rows)
    got = {r["ABC_Classification"][0]: r["Total_Category_Revenue"] for r in records(E.abc_percentile(tables))}
    assert got == {"A": 297.0, "B": 288.0, "C": 460.0}
    assert records(E.abc_percentile(totals(star, {"P1": 1})))[0]["ABC_Classification"][0] == "A"


def test_pivot_fills_absent_classes(star):
    tables = totals(star, {"P1": 1})
    row = records(E.pivot_abc(tables))[0]
    assert [row[c] for c in row if c != "Category"] == [2.5, 0.0, 0.0]
