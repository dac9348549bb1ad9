"""Stored summaries against recounts of the daily rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from conftest import day
from pyspark.sql import functions as F

from shelfsight.functions.numeric import exact_sum, quotient_sums, quotient_total
from shelfsight.operators import exploratory as E
from shelfsight.operators import production as Q
from shelfsight.plans.cores import PAIR, pair_history, pair_stats
from shelfsight.plans.summaries import SUMMARIES, days, fact_days, fact_months, months, summary_schema
from shelfsight.sources.parquet_tables import persist_star_schema

RNG = random.Random(7)
ROWS = [
    {
        "txn_date": day(d) if d % 17 else None, "store_id": f"S{d % 3}", "product_id": f"P{p}" if p else None,
        "region": RNG.choice(["North", "South", None]), "category": f"C{p % 2}", "price": RNG.choice([None, 1.25, 9.99]),
        "inventory_level": RNG.choice([None, 0, 12, 50, 51, 300]), "units_sold": RNG.choice([None, 0, 3, 40]),
        "units_ordered": RNG.choice([None, 0, 7, 11]), "demand_forecast": RNG.choice([None, 0.5, 33.25]),
        "seasonality": RNG.choice(["Winter", None]), "holiday_promotion": RNG.choice([0, 1, None]),
    }
    for d in range(70) for p in range(4)
]


@pytest.fixture(scope="module")
def both(spark, staging, star, tmp_path_factory):
    """The tables over summaries made on the way, and over stored ones."""
    folder = f"file://{tmp_path_factory.mktemp('summaries')}/star"
    return star(ROWS), persist_star_schema(staging(ROWS), folder)


def test_stored_and_made_on_the_way_are_alike(spark, both):
    lazy, stored = both
    for name, read in (("pair_months", months), ("day_totals", days)):
        assert sorted(map(str, read(lazy).collect())) == sorted(map(str, read(stored).collect()))
        assert read(stored).schema.simpleString() == summary_schema(spark, name).simpleString() and name in SUMMARIES


def test_counts_and_sums_are_those_of_the_rows(both):
    for tables in both:
        rows = tables.fact.count()
        assert fact_months(tables).agg(F.sum("rows")).first()[0] == fact_days(tables).agg(F.sum("rows")).first()[0] == rows
        assert months(tables).agg(F.sum("rows")).first()[0] == days(tables).agg(F.sum("rows")).first()[0] == len(ROWS)
        direct = tables.staging.agg(
            F.sum("units_sold"), F.count(F.when(F.col("inventory_level") <= 50, 1)), F.min("inventory_level"),
            F.sum(F.when(F.col("inventory_level") > 50, F.col("units_sold"))),
        ).first()
        merged = months(tables).agg(F.sum("sold_sum"), F.sum("low_50"), F.min("lowest"), F.sum("sold_above_50_sum")).first()
        assert tuple(direct) == tuple(merged)


def test_pairs_merge_to_their_whole_history(both):
    for tables in both:
        dated = [r for r in pair_stats(tables.fact).drop("on_hand").collect()]
        assert sorted(map(str, dated)) == sorted(map(str, pair_history(tables).drop("on_hand").select(*[
            c for c in pair_stats(tables.fact).columns if c != "on_hand"]).collect()))
        level = {(r.store_id, r.product_id): r.on_hand for r in pair_history(tables).collect()}
        last = defaultdict(set)
        for r in tables.fact.join(pair_history(tables).select(
                *[F.col(c).alias(f"of_{c}") for c in (*PAIR, "as_of_date")]),
                F.expr("store_id <=> of_store_id AND product_id <=> of_product_id AND txn_date = of_as_of_date")).collect():
            last[r.store_id, r.product_id].add(r.inventory_level)
        assert all(level[pair] in levels for pair, levels in last.items())


@pytest.mark.parametrize("limit", [0, 50, 12, 12.5, -3])
def test_limits_that_no_summary_knows(both, limit):
    lazy, stored = both
    expected = defaultdict(lambda: [0, 0])
    category = {r.product_id: r.category for r in lazy.products.collect()}
    for r in ROWS:
        if r["product_id"] is not None:
            of = expected[category[r["product_id"]]]
            of[0] += r["inventory_level"] is not None and r["inventory_level"] <= limit
            of[1] += r["txn_date"] is not None
    for tables in (lazy, stored):
        got = {r.Category: r.Stockout_Rate_Percent for r in E.kpi_by_category(tables, limit).collect()}
        assert got == {c: pytest.approx(100 * low / dated, abs=0.006) for c, (low, dated) in expected.items()}
    assert sorted(map(str, E.lost_revenue(lazy, limit).collect())) == sorted(map(str, E.lost_revenue(stored, limit).collect()))


def test_sums_of_quotients_do_not_depend_on_the_order(spark):
    values = [RNG.choice([1 / 3, 2 / 3, 1 / 7, -5 / 9, 1e9 / 7, 0.1, None]) for _ in range(2000)]
    seen = set()
    for k in (1, 3, 8):
        RNG.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "q double").repartition(k)
        merged = df.withColumn("k", F.spark_partition_id()).groupBy("k").agg(*quotient_sums(F.col("q"), "q"))
        total = merged.agg(*[F.sum(c).alias(c) for c in ("q_whole", "q_fraction", "q_n")])
        seen.add((*total.select(quotient_total("q"), "q_n").first(), df.agg(exact_sum(F.col("q"))).first()[0]))
    assert len(seen) == 1
    mean, n, other = seen.pop()
    known = [v for v in values if v is not None]
    assert n == len(known) and mean == pytest.approx(sum(known), rel=1e-12) and other == pytest.approx(mean, rel=1e-12)


def test_windowed_kpis_from_days_are_those_of_the_rows(both):
    for tables in both:
        got = Q.kpi_summary(tables, window=30).first()
        start = tables.as_of.toordinal() - 30
        rows = [r for r in ROWS if r["region"] and r["txn_date"] and r["txn_date"].toordinal() >= start]
        cover = [r["inventory_level"] / r["units_sold"] for r in rows if r["inventory_level"] is not None and r["units_sold"]]
        assert (got.fact_rows, got.days_in_window) == (len(rows), len({r["txn_date"] for r in rows}))
        assert got.avg_days_of_cover == pytest.approx(sum(cover) / len(cover), abs=0.051)
