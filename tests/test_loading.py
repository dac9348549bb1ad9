from __future__ import annotations

import datetime as dt
import gzip
from decimal import Decimal

import pytest
from conftest import day, records

from shelfsight.model import FACT_COLUMNS, SCHEMAS, STAGING_COLUMNS
from shelfsight.operators import loading as L
from shelfsight.sources.csv_files import load_staging, load_staging_with_rejects
from shelfsight.sources.parquet_tables import current_version, open_star_schema, persist_star_schema

ROWS = [
    {"txn_date": day(i), "store_id": f"S{s}", "product_id": f"P{p}", "category": f"C{p % 2}",
     "region": ["North", "South"][(i + s) % 2], "price": 1 + i, "units_sold": i + s + p}
    for i in range(40) for s in range(2) for p in range(3)
]


def test_date_attributes(star):
    days = [dt.date(2023, 1, 1), dt.date(2024, 2, 29), dt.date(2020, 12, 31)]
    got = {r["date_key"]: r for r in records(star([{"txn_date": d} for d in days]).dim_date)}
    sunday = got[days[0]]
    assert (sunday["day_of_week"], sunday["is_weekend"], sunday["week_of_year"]) == (7, True, 52)
    assert (sunday["month_name"], sunday["day_name"], sunday["year"]) == ("January", "Sunday", 2023)
    assert (got[days[1]]["day"], got[days[1]]["quarter"], got[days[1]]["is_weekend"]) == (29, 1, False)
    assert got[days[2]]["week_of_year"] == 53


def test_schemas(star):
    tables = star(ROWS)
    for name, schema in SCHEMAS.items():
        assert [(f.name, f.dataType) for f in tables.table(name).schema.fields] == [
            (f.name, f.dataType) for f in schema.fields
        ], name


def test_regions_are_numbered_by_name_and_resolved(star):
    tables = star([{"region": r, "store_id": r} for r in ("West", "East", "North")])
    assert records(tables.dim_region.orderBy("region_id")) == [
        {"region_id": 1, "region_name": "East"},
        {"region_id": 2, "region_name": "North"},
        {"region_id": 3, "region_name": "West"},
    ]
    by_store = {r["store_id"]: r["region_id"] for r in records(tables.fact)}
    assert by_store == {"West": 3, "East": 1, "North": 2}


def test_row_of_unknown_region_drops_out(star):
    tables = star([{"region": None, "store_id": "S9"}, {"store_id": "S1"}])
    assert [r["store_id"] for r in records(tables.fact)] == ["S1"]
    assert L.staging_row_count(tables).first()[0] == 2


def test_as_of_skips_months_without_fact_rows(star):
    tables = star([{"txn_date": day(3)}, {"txn_date": day(90), "region": None}])
    assert tables.as_of == day(3)


def test_first_seen_product(star):
    tables = star([
        {"txn_date": day(2), "price": 9, "category": "Late"},
        {"txn_date": day(1), "store_id": "S2", "price": 5},
        {"txn_date": day(1), "store_id": "S1", "price": 7, "category": "First"},
        {"product_id": "P2", "price": 3},
    ])
    assert {r["product_id"]: (r["category"], r["price"]) for r in records(tables.products)} == {
        "P1": ("First", Decimal("7.00")),
        "P2": ("Toys", Decimal("3.00")),
    }


def test_flat_model_and_counts(star):
    tables = star(ROWS)
    assert L.flat_inventory_log(tables).columns == [
        h for h, n, _, _ in STAGING_COLUMNS if n not in ("category", "price", "weather_condition")
    ]
    assert L.flat_products(tables).columns == ["Product ID", "Category", "Price"]
    counts = {r["table_name"]: r["rows"] for r in records(L.table_row_counts(tables))}
    assert counts == {"fact_inventory_daily": 240, "dim_date": 40, "dim_product": 3,
                      "dim_store": 2, "dim_region": 2}


def test_profile(star):
    lines = records(L.profile_staging(star([{}, {"store_id": "S2", "price": None}])))
    assert [x["column_name"] for x in lines] == [n for _, n, _, _ in STAGING_COLUMNS]
    price = next(x for x in lines if x["column_name"] == "price")
    assert (price["column_type"], price["non_null"], price["rows"]) == ("decimal(10,2)", 1, 2)


def test_persist_is_repeatable_and_equal(spark, star, staging, tmp_path):
    folder = f"file://{tmp_path}/star"
    persist_star_schema(staging(ROWS[:50]), folder)
    stored = persist_star_schema(staging(ROWS), folder)
    lazy = star(ROWS)
    for name in SCHEMAS:
        assert sorted(stored.table(name).collect()) == sorted(lazy.table(name).collect()), name
    assert open_star_schema(spark, folder).as_of == day(39)
    version = tmp_path / "star" / current_version(spark, folder)
    assert {p.name for p in (version / "fact_inventory_daily").glob("txn_month=*")} == {
        "txn_month=202301", "txn_month=202302"
    }
    assert stored.table("fact_inventory_daily").columns == FACT_COLUMNS


def test_a_load_that_fails_leaves_the_one_before(spark, star, staging, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/star"
    with pytest.raises(FileNotFoundError):
        open_star_schema(spark, folder)
    persist_star_schema(staging(ROWS[:50]), folder)
    reading = open_star_schema(spark, folder)
    for broken in ("build_fact", "build_dim_region", "first_seen_products"):
        with monkeypatch.context() as patch:
            patch.setattr(L, broken, lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                persist_star_schema(staging(ROWS), folder)
        left = open_star_schema(spark, folder)
        assert left.staging.count() == left.fact.count() == 50
    persist_star_schema(staging(ROWS), folder)
    assert open_star_schema(spark, folder).fact.count() == len(ROWS)
    # Analyses on the load before can end; what failed loads left is gone.
    assert reading.fact.count() == 50
    assert len([p for p in (tmp_path / "star").iterdir() if p.name.startswith("version-")]) == 2
    persist_star_schema(staging(ROWS), folder)
    assert len([p for p in (tmp_path / "star").iterdir() if p.name.startswith("version-")]) == 2


def test_stored_layout_keeps_pairs_together(spark, staging, tmp_path):
    folder = f"file://{tmp_path}/star"
    stored = persist_star_schema(staging(ROWS), folder)
    for name in ("staging_inventory", "fact_inventory_daily"):
        for path in stored.table(name).inputFiles():
            rows = spark.read.parquet(path).select("txn_date", "product_id", "store_id").collect()
            keys = [(r.txn_date.month, r.product_id, r.store_id, r.txn_date) for r in rows]
            assert keys == sorted(keys), path
            assert name == "staging_inventory" or len({k[0] for k in keys}) == 1


# --- CSV ------------------------------------------------------------------------


def _write_csv(path, rows, headers=None):
    headers = headers or [h for h, _, _, _ in STAGING_COLUMNS]
    lines = [",".join(headers)] + [",".join(r[h] for h in headers) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


GOOD = {
    "Date": "2023-05-01", "Store ID": "S1", "Product ID": "P1", "Category": "Toys",
    "Region": "North", "Inventory Level": "5", "Units Sold": "1", "Units Ordered": "2",
    "Demand Forecast": "1.25", "Price": "9.99", "Discount": "10", "Weather Condition": "Rainy",
    "Holiday/Promotion": "1", "Competitor Pricing": "9.50", "Seasonality": "Spring",
}


def test_csv_columns_are_found_by_name(spark, tmp_path):
    headers = list(reversed(GOOD)) + ["Remark"]
    path = _write_csv(tmp_path / "a.csv", [{**GOOD, "Remark": "x"}], headers)
    df = load_staging(spark, path)
    assert df.schema == SCHEMAS["staging_inventory"]
    row = df.first()
    assert (row.txn_date, row.price, row.holiday_promotion, row.seasonality) == (
        dt.date(2023, 5, 1), Decimal("9.99"), 1, "Spring")


def test_csv_with_a_bad_value_ends_the_load(spark, tmp_path):
    path = _write_csv(tmp_path / "b.csv", [GOOD, {**GOOD, "Units Sold": "many"}])
    with pytest.raises(Exception, match="(?i)malformed"):
        persist_star_schema(load_staging(spark, path), f"file://{tmp_path}/star")
    good, bad = load_staging_with_rejects(spark, path)
    assert good.count() == 1
    assert "many" in bad.first()["_corrupt_record"]
    assert good.select("store_id").count() == 1 and bad.select("store_id").count() == 1


def test_csv_without_a_column_is_refused(spark, tmp_path):
    headers = [h for h in GOOD if h != "Price"]
    path = _write_csv(tmp_path / "c.csv", [GOOD], headers)
    with pytest.raises(ValueError, match="Price"):
        load_staging(spark, path)


def test_csv_to_star_schema(spark, tmp_path):
    rows = [{**GOOD, "Date": f"2023-05-{d:02d}", "Store ID": s} for d in range(1, 11) for s in ("S1", "S2")]
    path = _write_csv(tmp_path / "d.csv", rows)
    tables = persist_star_schema(load_staging(spark, path), f"file://{tmp_path}/star")
    assert tables.fact.count() == 20
    assert tables.as_of == dt.date(2023, 5, 10)


def test_files_of_another_column_order_are_read_by_name(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    headers = list(GOOD)
    i, j = headers.index("Units Sold"), headers.index("Units Ordered")
    swapped = headers.copy()
    swapped[i], swapped[j] = swapped[j], swapped[i]
    _write_csv(folder / "1.csv", [GOOD, {**GOOD, "Store ID": "S9"}], headers)
    _write_csv(folder / "2.csv", [{**GOOD, "Store ID": "S2"}], swapped)
    _write_csv(folder / "3.csv", [{**GOOD, "Store ID": "S3", "Remark": "x"}], ["Remark", *reversed(headers)])
    with gzip.open(folder / "4.csv.gz", "wt") as packed:
        packed.write((folder / "2.csv").read_text().replace("S2", "S4"))
    (folder / "5.csv").write_text("")
    (folder / "_hidden.csv").write_text("a,b\n1,2\n")
    expected = [(s, 1, 2) for s in ("S1", "S2", "S3", "S4", "S9")]
    loaded = load_staging(spark, str(folder))
    assert loaded.schema == SCHEMAS["staging_inventory"]
    assert sorted((r.store_id, r.units_sold, r.units_ordered) for r in loaded.collect()) == expected
    _write_csv(folder / "6.csv", [{**GOOD, "Units Sold": "many"}], swapped)
    good, bad = load_staging_with_rejects(spark, str(folder))
    assert sorted((r.store_id, r.units_sold, r.units_ordered) for r in good.collect()) == expected
    assert "many" in bad.first()["_corrupt_record"] and bad.count() == 1
    only = load_staging(spark, str(folder / "[12].csv"))
    assert only.count() == 3
    (folder / "7.csv").write_text("\n")
    _write_csv(folder / "8.csv", [{"Date": "2023-05-01"}], ["Date"])
    with pytest.raises(ValueError, match="Price"):
        load_staging(spark, str(folder))


def test_money_with_three_decimals_is_no_silent_loss(spark, tmp_path):
    path = _write_csv(tmp_path / "fine.csv", [GOOD, {**GOOD, "Price": "9.999"}])
    with pytest.raises(Exception, match="Malformed Price"):
        load_staging(spark, path).collect()
    good, bad = load_staging_with_rejects(spark, path)
    assert good.count() == 1 and "9.999" in bad.first()["_corrupt_record"]
