from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from conftest import day, records

from shelfsight.operators import dashboard as D
from shelfsight.operators import production as Q
from shelfsight.operators import recommendations as R


def levels(star, values):
    return star([{"txn_date": day(i % 300), "store_id": f"S{i // 300}", "inventory_level": v}
                 for i, v in enumerate(values)])


@pytest.mark.parametrize("values", [
    [random.Random(3).randint(0, 300) for _ in range(500)], [0, 300], list(range(0, 801)), [7, 7, 7], [-5, 0, 5, 40],
])
def test_histogram_against_numpy(star, values):
    counts, edges = np.histogram(np.array(values), bins=40)
    got = records(D.histogram(levels(star, values)))
    assert [r["bin"] for r in got] == list(range(40))
    assert sum(r["n"] for r in got) == len(values)
    assert [r["n"] for r in got] == list(counts)
    assert [r["lower"] for r in got] == pytest.approx(list(edges[:-1]))
    assert got[-1]["upper"] == pytest.approx(edges[-1])


@pytest.mark.parametrize("values", [[1], [1, 2], [5, 1, 1, 9], list(range(101)), [3] * 40 + [4] * 41,
                                    [-70_000, -3, 65_535, 65_536, 200_000, 2**31 - 1], [65_535] * 5 + [65_536] * 5,
                                    [0, 0, 10**6, 10**6, 10**6]])
def test_mean_and_median(star, values):
    row = D.mean_median(levels(star, values)).first()
    assert (row["mean"], row["median"]) == (pytest.approx(np.mean(values)), np.median(values))


def test_mean_and_median_of_nothing(star):
    assert tuple(D.mean_median(star([{"region": None}])).first()) == (None, None)


def test_rolling_means_against_pandas(star):
    rng = random.Random(5)
    days = sorted(rng.sample(range(200), 80))
    frame = pd.DataFrame({"d": days, "u": [rng.randint(0, 50) for _ in days]})
    got = records(D.daily_trend(star([{"txn_date": day(d), "units_sold": u} for d, u in zip(frame.d, frame.u)])))
    for rows in (7, 30):
        expected = frame.u.rolling(rows, min_periods=1).mean()
        assert [r[f"ma_{rows}"] for r in got] == pytest.approx(list(expected))


def test_forecast_error_without_sales_is_null(star):
    tables = star([{"units_sold": 0}, {"txn_date": day(1), "units_sold": 8, "demand_forecast": 10}])
    assert [r["err_pct"] for r in records(D.forecast_vs_actual(tables))] == [None, 25.0]


def test_actions_are_complete_and_ordered(star):
    tables = star([{"txn_date": day(i), "units_sold": n, "inventory_level": 1} for i, n in enumerate([8, 12])])
    assert records(D.action_counts(tables)) == [{"action": "INCREASE", "n": 1}]
    assert [tuple(r.values()) for r in records(D.complete_actions(tables))] == [
        ("INCREASE", 1), ("HOLD", 0), ("DECREASE", 0)]


def test_action_counts_use_unrounded_levels(star):
    sold = [8, 12]  # reorder point 82.35: rounded 82, so stock of 82 is advised on differently
    tables = star([{"txn_date": day(i), "units_sold": n, "inventory_level": 82} for i, n in enumerate(sold)])
    assert records(Q.stock_adjustments(tables))[0]["action"] == "HOLD"
    assert records(D.action_counts(tables)) == [{"action": "INCREASE", "n": 1}]


def test_monthly_totals_join_years(star):
    tables = star([{"txn_date": day(0)}, {"txn_date": day(365)}, {"txn_date": day(40)}])
    assert [tuple(r.values()) for r in records(D.monthly_seasonality(tables))] == [(1, "Jan", 20), (2, "Feb", 10)]


def test_pivot_and_mix(star):
    tables = star([
        {"units_sold": 4, "price": 1}, {"store_id": "S2", "region": "East", "units_sold": 2, "price": 1},
        {"product_id": "P2", "category": "Books", "units_sold": 2, "price": 1},
    ])
    assert records(D.pivot_category_region(tables)) == [
        {"category": "Books", "East": None, "North": 2.0}, {"category": "Toys", "East": 2.0, "North": 4.0}]
    assert [tuple(r.values()) for r in records(D.revenue_mix(tables))] == [("Toys", 6.0, 75.0), ("Books", 2.0, 25.0)]
    assert [tuple(r.values()) for r in records(D.category_sales(tables))] == [("Toys", 6.0, 6), ("Books", 2.0, 2)]


def test_top_products_and_units(star):
    tables = star([{"product_id": f"P{i:02d}", "units_sold": i + 1, "price": 1000} for i in range(20)])
    top = records(D.top_products(tables))
    assert [r["product_id"] for r in top] == [f"P{i:02d}" for i in range(19, 4, -1)]
    assert records(D.top_products_in_millions(tables))[0]["revenue_m"] == 0.02
    assert records(D.monthly_in_thousands(tables)) == [{"m_label": "Jan", "units_k": 0.21}]
    assert records(D.stores_in_millions(tables))[0]["revenue_m"] == 0.21


def test_kpi_cards(star):
    row = records(D.kpi_cards(star([{"inventory_level": 0}, {"store_id": "S2", "inventory_level": 5}])))[0]
    assert row == {"units_sold": 20, "revenue": 50.0, "avg_stock": 2.5, "stockout_pct": 50.0, "turnover": 8.0}


# --- recommendations ---------------------------------------------------------------


def test_velocity_gap(star):
    rows = [{"txn_date": day(i), "units_sold": 10, "units_ordered": o} for i, o in enumerate([0, 0, 10, 10, 10, 10, 10, 10, 10, 7])]
    rows += [{"txn_date": day(9), "store_id": "S2", "units_ordered": 10}]
    got = records(R.trailing_velocity_gap(star(rows)))
    assert [tuple(r.values()) for r in got] == [("S1", "P1", 77, 80, 10.0, 3)]


def test_critical_class_a(star):
    tables = star([
        {"product_id": "P1", "units_sold": 40, "inventory_level": 50},
        {"product_id": "P2", "units_sold": 30, "inventory_level": 500},
        {"product_id": "P3", "units_sold": 30, "inventory_level": 1},
    ])
    assert [(r["product_id"], r["days_of_supply"]) for r in records(R.critical_class_a(tables))] == [("P1", 1.25)]


def test_category_days_of_supply(star):
    tables = star([{"inventory_level": 15}, {"product_id": "P2", "category": "Books", "units_sold": 0}])
    assert [(r["category"], r["days_of_supply"]) for r in records(R.category_days_of_supply(tables))] == [
        ("Toys", 1.5), ("Books", None)]
