"""Edge frames with expected values worked out by hand, and a pandas recount."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import day, records

from shelfsight.operators import production as Q
from shelfsight.params import ReorderPolicy


def one(df):
    rows = records(df)
    assert len(rows) == 1
    return rows[0]


def test_current_stock_uses_the_last_row_and_the_unrounded_mean(star):
    tables = star([
        {"txn_date": day(0), "inventory_level": 999, "units_sold": 500},
        {"txn_date": day(40), "units_sold": 1},
        {"txn_date": day(41), "units_sold": 1},
        {"txn_date": day(42), "units_sold": 2, "inventory_level": 7},
        {"txn_date": day(42), "store_id": "S2", "units_sold": 0, "inventory_level": 4},
        {"txn_date": day(5), "store_id": "S3"},
    ])
    rows = records(Q.current_stock_levels(tables))
    assert [r["store_id"] for r in rows] == ["S1", "S2"]  # S3 has no row in the window
    assert (rows[0]["as_of_date"], rows[0]["on_hand"]) == (day(42), 7)
    assert rows[0]["avg_daily_demand_30d"] == 1.33
    assert rows[0]["days_of_cover"] == 5.3  # 7 / 1.3333, not 7 / 1.33
    assert rows[1]["days_of_cover"] is None  # no demand: sorted last


def test_window_holds_both_ends(star):
    tables = star([{"txn_date": day(i), "units_sold": i} for i in (9, 10, 40)])
    assert one(Q.current_stock_levels(tables))["avg_daily_demand_30d"] == 25.0
    assert one(Q.kpi_summary(tables, window=30))["days_in_window"] == 2


def test_alerts(star):
    sold = [8, 12]
    rows = []
    for store, stock in (("S1", 0), ("S2", 82), ("S3", 83)):
        rows += [{"txn_date": day(i), "store_id": store, "units_sold": n, "inventory_level": stock}
                 for i, n in enumerate(sold)]
    rows.append({"txn_date": day(1), "store_id": "S4", "inventory_level": 0})  # one row: sigma unknown
    safety = 1.65 * np.std(sold, ddof=1) * math.sqrt(7)  # 12.35
    got = records(Q.low_inventory_alerts(star(rows)))
    assert [(r["store_id"], r["status"]) for r in got] == [("S1", "STOCKOUT"), ("S2", "REORDER NOW")]
    assert (got[0]["cycle_stock"], got[0]["safety_stock"], got[0]["reorder_point"]) == (
        70.0, round(safety), round(70 + safety))


def test_adjustments(star):
    sold = [8, 12]  # reorder point 82, ceiling 117
    rows = []
    for store, stock in (("S1", 81), ("S2", 82), ("S3", 117), ("S4", 120)):
        rows += [{"txn_date": day(i), "store_id": store, "units_sold": n, "inventory_level": stock}
                 for i, n in enumerate(sold)]
    rows.append({"txn_date": day(1), "store_id": "S5", "inventory_level": 0})
    got = {r["store_id"]: (r["action"], r["units_to_adjust"]) for r in records(Q.stock_adjustments(star(rows)))}
    assert got == {"S1": ("INCREASE", 36.0), "S2": ("HOLD", 0.0), "S3": ("HOLD", 0.0),
                   "S4": ("DECREASE", 3.0), "S5": ("HOLD", 0.0)}


def test_policy_changes_the_levels(star):
    tables = star([{"txn_date": day(i), "units_sold": n} for i, n in enumerate([8, 12])])
    row = one(Q.reorder_points(tables, ReorderPolicy(lead_time_days=4, z_score=0, max_factor=2)))
    assert (row["reorder_point"], row["max_stock_level"], row["safety_stock"]) == (40.0, 80.0, 0.0)
    assert (row["avg_daily_demand"], row["demand_std_dev"], row["peak_demand"]) == (10.0, 2.8, 12)


def test_turnover_guards(star):
    tables = star([
        {"product_id": "P1", "inventory_level": 0, "units_sold": 5},
        {"product_id": "P2", "inventory_level": 10, "units_sold": 0},
        {"product_id": "P3", "inventory_level": 8, "units_sold": 4},
    ])
    got = {r["product_id"]: (r["turnover_ratio"], r["days_inventory_outstanding"]) for r in records(Q.turnover(tables))}
    assert got == {"P1": (None, None), "P2": (0.0, None), "P3": (0.5, 730.0)}


def test_kpis(star):
    tables = star([
        {"txn_date": day(0), "inventory_level": 0, "units_sold": 4, "price": 2.5, "demand_forecast": 3.5},
        {"txn_date": day(0), "store_id": "S2", "inventory_level": 10, "units_sold": 0},
        {"txn_date": day(1), "inventory_level": 8, "units_sold": 2, "price": 1.25, "demand_forecast": 2},
    ])
    assert one(Q.kpi_summary(tables)) == {
        "days_in_window": 2, "fact_rows": 3, "total_units_sold": 6, "gross_revenue": 13.0,
        "avg_stock_level": 6.0, "stockout_rate_pct": 33.33, "zero_sale_rate_pct": 33.33,
        "avg_days_of_cover": 2.0, "turnover_90d": 1.0, "forecast_under_pct": 33.33,
    }


def test_kpis_without_rows(star):
    row = one(Q.kpi_summary(star([{"region": None}])))
    assert (row.pop("days_in_window"), row.pop("fact_rows")) == (0, 0)
    assert set(row.values()) == {None}


def test_abc_boundaries(star):
    def classes(revenues):
        tables = star([{"product_id": p, "units_sold": n, "price": 1} for p, n in revenues.items()])
        return {r["product_id"]: r["abc_class"][0] for r in records(Q.abc_analysis(tables))}

    assert classes({"P1": 70, "P2": 20, "P3": 10}) == {"P1": "A", "P2": "B", "P3": "C"}
    assert classes({"P1": 71, "P2": 19, "P3": 10}) == {"P1": "B", "P2": "B", "P3": "C"}
    assert classes({"P1": 50}) == {"P1": "C"}  # alone, and already at 100 %
    assert classes({"P2": 35, "P1": 35, "P3": 30}) == {"P1": "A", "P2": "A", "P3": "C"}


def test_supplier_guards(star):
    tables = star([
        {"txn_date": day(0), "units_ordered": 0, "units_sold": 9, "demand_forecast": 1.5},
        {"txn_date": day(1), "units_ordered": 4, "units_sold": 2, "demand_forecast": 6},
    ])
    row = one(Q.supplier_performance(tables))
    assert (row["fill_rate_proxy"], row["order_variability"], row["order_vs_forecast_mae"]) == (0.5, 2.8, 1.8)
    lone = one(Q.supplier_performance(star([{"units_ordered": 0}])))
    assert (lone["fill_rate_proxy"], lone["order_variability"]) == (None, None)


def test_forecast_frames_count_rows_and_start_with_the_window(star):
    days = [0] + [30 + 2 * i for i in range(10)]  # gaps, and one row before the window
    sold = [1000, 0, 2, 4, 6, 8, 10, 12, 14, 16, 18]
    tables = star([{"txn_date": day(d), "units_sold": n} for d, n in zip(days, sold)])
    got = records(Q.demand_forecast(tables, window=20))
    assert [r["txn_date"] for r in got] == [day(d) for d in days[1:]]
    assert [r["ma_7d"] for r in got][:3] == [0.0, 1.0, 2.0]
    assert got[9]["ma_7d"] == 12.0 and got[9]["ma_30d"] == 9.0
    assert [r["wow_growth_pct"] for r in got] == [None] * 7 + [None, 700.0, 350.0]  # zero base, then growth


def test_category_region(star):
    tables = star([
        {"category": "A", "inventory_level": 0, "units_sold": 1},
        {"category": "A", "store_id": "S2", "inventory_level": 3, "units_sold": 2},
        {"category": "A", "store_id": "S3", "region": "South", "inventory_level": 5},
        {"product_id": "P2", "category": "B", "inventory_level": 0},
    ])
    got = [tuple(r.values()) for r in records(Q.stockout_by_category_region(tables))]
    assert got == [("A", "North", 2, 1, 50.0, 1.5, 1.5), ("A", "South", 1, 0, 0.0, 5.0, 10.0),
                   ("B", "North", 1, 1, 100.0, 0.0, 10.0)]


def test_product_with_two_categories_counts_in_both(star):
    tables = star([{"category": "A", "units_sold": 3}, {"store_id": "S2", "category": "B", "units_sold": 4}])
    assert [(r["category"], r["units_sold"]) for r in records(Q.abc_analysis(tables))] == [("A", 7), ("B", 7)]
    assert [r["fact_rows"] for r in records(Q.stockout_by_category_region(tables))] == [2, 2]


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(11)
    return [
        {"txn_date": day(d), "store_id": f"S{s}", "product_id": f"P{p}", "category": f"C{p % 3}",
         "region": f"R{rng.randint(0, 2)}", "inventory_level": rng.choice([0, 5, 40, 60, 300]),
         "units_sold": rng.randint(0, 20), "units_ordered": rng.randint(0, 20),
         "demand_forecast": rng.randint(0, 2000) / 100, "price": rng.randint(100, 900) / 100}
        for d in range(130) for s in range(3) for p in range(7) if rng.random() < 0.4
    ]


def test_levels_against_pandas(star, random_rows):
    frame = pd.DataFrame(random_rows)
    stats = frame.groupby(["store_id", "product_id"]).units_sold.agg(["mean", "std", "max"])
    got = {(r["store_id"], r["product_id"]): r for r in records(Q.reorder_points(star(random_rows)))}
    assert len(got) == len(stats)
    for key, s in stats.iterrows():
        rop = s["mean"] * 7 + 1.65 * s["std"] * math.sqrt(7)
        assert got[key]["reorder_point"] == pytest.approx(rop, abs=0.5001)
        assert got[key]["peak_demand"] == s["max"]
    recent = frame[frame.txn_date >= frame.txn_date.max() - pd.Timedelta(days=90)]
    s = recent.groupby(["store_id", "product_id"]).units_sold.agg(["mean", "std"])
    last = frame.sort_values("txn_date").groupby(["store_id", "product_id"]).inventory_level.last()
    rop = s["mean"] * 7 + 1.65 * s["std"] * math.sqrt(7)
    low = {k for k, v in (last <= rop).items() if v}
    assert {(r["store_id"], r["product_id"]) for r in records(Q.low_inventory_alerts(star(random_rows)))} == low


def test_properties(star, random_rows):
    tables = star(random_rows)
    shares = records(Q.revenue_shares(tables))
    assert sum(r["share"] for r in shares) == pytest.approx(100)
    assert max(r["cumulative_share"] for r in shares) == pytest.approx(100)
    pairs = {(r["store_id"], r["product_id"]) for r in random_rows}
    assert len(records(Q.stock_adjustments(tables))) == len(pairs)


@pytest.mark.parametrize("analysis", [Q.kpi_summary, Q.abc_analysis, Q.supplier_performance, Q.reorder_points])
def test_partitioning_does_not_matter(staging, random_rows, analysis):
    from shelfsight.operators.loading import star_from_staging

    frames = [staging(random_rows).repartition(n, *cols) for n, cols in ((1, []), (7, ["store_id"]))]
    results = [analysis(star_from_staging(f)).collect() for f in frames]
    assert results[0] == results[1]
