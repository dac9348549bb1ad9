"""Every registered query against its SQL counterpart on the sample tables."""

from __future__ import annotations

import pathlib

import duckdb
import pytest

import __spark_entry__ as driver
from shelfsight.oracles import ORACLES
from shelfsight.suite import CATALOGUE

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SMALL).exists(), reason="sample tables absent")

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "date": "DATE", "smallint": "SMALLINT", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in pathlib.Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_a_counterpart():
    assert set(CATALOGUE) == set(ORACLES)
    assert set(CATALOGUE) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", CATALOGUE)
def test_same_rows_and_types(spark, duck, name):
    ours = driver.queries()[name](spark, SMALL)
    theirs = duck.execute(driver.oracle_sql()[name])
    names = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    kinds = {c[0]: str(c[1]).replace(" ", "") for c in theirs.description}
    for column, kind in ours.dtypes:
        assert kinds[column] == TYPES.get(kind, kind.upper()), column
    left = sorted((tuple(row[c] for c in names) for row in ours.collect()), key=repr)
    right = sorted(theirs.fetchall(), key=repr)
    assert left == right


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 31
    assert {r.status for r in rows} <= {"STOCKOUT", "REORDER NOW"}


def test_tables_are_built_once_per_data_state(spark, tmp_path):
    import shutil

    for name in driver.BASE_TABLES:
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path)
    first = driver.tables_for(spark, str(tmp_path))
    assert driver.tables_for(spark, str(tmp_path)) is first
    (tmp_path / "region.parquet").touch()
    assert driver.tables_for(spark, str(tmp_path)) is not first
