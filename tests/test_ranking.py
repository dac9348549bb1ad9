from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfsight.plans.ranking import RANGE, percent_rank, with_descending_order
from shelfsight.workspace import written

COLUMNS = ["id", "value", "rank", "running", "total", "row_total", "pr"]


def _ordered(df):
    out = with_descending_order(df, "value", ["id"]).withColumn("pr", percent_rank())
    return sorted(out.select(*COLUMNS).collect())


def _frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, value bigint").repartition(4)


def _expected(values):
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    out, running = {}, None
    for i in order:
        if values[i] is not None:
            running = (running or 0) + values[i]
        ahead = sum(
            1 for v in values if v is not None and (values[i] is None or v > values[i])
        )
        out[i] = (ahead + 1, running)
    return out


CASES = {
    "distinct": [random.Random(1).randint(0, 10**6) for _ in range(300)],
    "a third shares one value": [0] * 150 + list(range(1, 301)),
    "a tie across all ranges": [7] * 200,
    "ties at both ends": [9] * 90 + [5] * 30 + [1] * 90,
    "ties and missing": [None] * 40 + [3] * 60 + list(range(100)),
    "few levels": [random.Random(2).randint(0, 4) for _ in range(400)],
    "one row": [5],
    "negative": [-3, -1, -1, 0, 2],
}


@pytest.mark.parametrize("case", CASES)
def test_agrees_with_counting(spark, case):
    values = CASES[case]
    rows = _ordered(_frame(spark, values))
    assert len(rows) == len(values)
    expected = _expected(values)
    for row in rows:
        rank, running = expected[row.id]
        assert row.rank == rank
        assert row.running == running
        assert row.row_total == len(values)
        assert row.pr == ((rank - 1) / (len(values) - 1) if len(values) > 1 else 0.0)


@pytest.mark.parametrize("values", [[7] * 20_000, [0] * 19_000 + list(range(1000)), [None] * 20_000, list(range(20_000))])
def test_no_range_is_much_larger_than_the_others(spark, monkeypatch, values):
    from shelfsight.plans import ranking

    ranged = []

    def kept(df, label):
        ranged.append(written(df, label))
        return ranged[-1]

    monkeypatch.setattr(ranking, "written", kept)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = _frame(spark, values)
        out = with_descending_order(rows, "value", ["id"])
        sizes = sorted(r["count"] for r in ranged[0].groupBy(F.expr(RANGE)).count().collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        ranks = {r.id: (r.rank, r.running) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, running, rank = {}, None, 0
    for place, i in enumerate(sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0), i))):
        running = running if values[i] is None else (running or 0) + values[i]
        rank = rank if place and values[i] == before else place + 1
        before = values[i]
        expected[i] = rank, running
    assert ranks == expected


def test_input_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = _frame(spark, list(range(100)))
    counted = spark.createDataFrame(rows.rdd.map(lambda r: (seen.add(1), tuple(r))[1]), rows.schema)
    out = with_descending_order(counted.groupBy("id").agg({"value": "max"}).toDF("id", "value"), "value", ["id"])
    out.collect()
    out.count()
    assert seen.value == 100


def test_empty(spark):
    assert _ordered(_frame(spark, [1]).filter("id < 0")) == []


def test_totals_beyond_a_machine_word(spark):
    rows = _ordered(_frame(spark, [2**62] * 6))
    assert rows[-1].running == rows[0].total == 6 * 2**62
