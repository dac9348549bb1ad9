from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.functions.numeric import mean_of, moments, percent, ratio, round_to, sample_sd_of


def test_rounding_follows_the_binary_value(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (2.675,), (2.5,), (-2.5,), (None,)], "x double")
    got = [r[0] for r in df.select(round_to(F.col("x"), 2)).collect()]
    assert got[:3] == [math.floor(v * 100 + 0.5) / 100 for v in (1.005, 0.285, 2.675)]
    assert got[3:] == [2.5, -2.5, None]
    assert [r[0] for r in df.select(round_to(F.col("x"), 0)).collect()][3:] == [3.0, -3.0, None]


def test_division_by_zero_gives_null(spark):
    row = spark.range(1).select(
        ratio(F.lit(3), F.lit(0)).alias("a"),
        ratio(F.lit(3), F.lit(2)).alias("b"),
        percent(F.lit(1), F.lit(0)).alias("c"),
        percent(F.lit(1), F.lit(4)).alias("d"),
    ).first()
    assert tuple(row) == (None, 1.5, None, 25.0)


@pytest.mark.parametrize("n", [1, 2, 500])
def test_moments_match_numpy(spark, n):
    values = [random.Random(n).randint(0, 10_000) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x int").repartition(5)
    mean, sd = df.agg(*moments("x", "x")).select(mean_of("x"), sample_sd_of("x")).first()
    assert mean == pytest.approx(np.mean(values), rel=1e-15)
    assert sd is None if n == 1 else sd == pytest.approx(np.std(values, ddof=1), rel=1e-12)


def test_large_moments_do_not_overflow(spark):
    big = 2**31 - 1
    df = spark.createDataFrame([(big,), (0,), (big,), (0,)], "x int")
    assert df.agg(*moments("x", "x")).select(sample_sd_of("x")).first()[0] == pytest.approx(
        np.std([big, 0, big, 0], ddof=1)
    )
