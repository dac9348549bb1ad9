from __future__ import annotations

from dataclasses import replace

import pytest
from conftest import day, records

from shelfsight.operators import quality as V


def counts(df) -> dict[str, int]:
    return {r["check"]: r["violations"] for r in records(df)}


def test_clean_tables_have_no_violations(star):
    tables = star([{"txn_date": day(i), "product_id": f"P{p}"} for i in range(5) for p in range(3)])
    for check in (V.fact_key_unique, V.dimension_keys_unique, V.foreign_keys, V.value_ranges, V.nulls, V.text_lengths):
        found = counts(check(tables))
        assert found and set(found.values()) == {0}, found


def test_repeated_fact_key(star):
    tables = star([{}, {}, {}, {"store_id": "S2"}])
    assert list(counts(V.fact_key_unique(tables)).values()) == [1]
    assert [r["rows"] for r in records(V.repeated_keys(tables.fact, V.FACT_KEY))] == [3]


def test_two_seasons_and_two_categories(star):
    tables = star([{}, {"store_id": "S2", "seasonality": "Summer"}, {"store_id": "S3", "category": "Books"}])
    found = counts(V.dimension_keys_unique(tables))
    assert (found["dim_date(date_key)"], found["dim_product(product_id)"], found["dim_store(store_id)"]) == (1, 1, 0)


def test_orphans_count_fact_rows(star):
    tables = star([{"store_id": s, "txn_date": day(i)} for i in range(4) for s in ("S1", "S2")])
    cut = replace(tables, dim_store=tables.dim_store.filter("store_id = 'S1'"),
                  dim_date=tables.dim_date.filter("day > 1"))
    found = counts(V.foreign_keys(cut))
    assert found == {"txn_date -> dim_date.date_key": 2, "store_id -> dim_store.store_id": 4,
                     "product_id -> dim_product.product_id": 0, "region_id -> dim_region.region_id": 0}


def test_ranges(star):
    tables = star([{"inventory_level": -1}, {"store_id": "S2", "units_sold": -5}, {"store_id": "S3", "discount": 101},
                   {"store_id": "S4", "discount": -1, "units_sold": -1}, {"store_id": "S5", "discount": 100}])
    assert list(counts(V.value_ranges(tables)).values()) == [1, 2, 2]
    assert sorted(r["store_id"] for r in records(V.rows_out_of_range(tables))) == ["S1", "S2", "S3", "S4"]


@pytest.mark.parametrize("column", ["price", "weather_condition", "units_sold"])
def test_nulls(star, column):
    found = counts(V.nulls(star([{column: None}, {"store_id": "S2"}])))
    assert found[f"staging_inventory.{column}"] == 1
    assert found[f"fact_inventory_daily.{column}"] == 1


def test_text_lengths(star):
    found = counts(V.text_lengths(star([{"store_id": "S" * 11}, {"store_id": "S" * 10, "category": "c" * 51}])))
    assert found["staging_inventory.store_id <= 10"] == 1
    assert found["dim_store.store_id <= 10"] == 1
    assert found["dim_product.category <= 50"] == 1
