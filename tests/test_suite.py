from __future__ import annotations

import threading

import pytest
from conftest import day

from shelfsight import suite
from shelfsight.workspace import new_folder, shared_folder

ROWS = [{"txn_date": day(i), "product_id": f"P{p}", "store_id": f"S{s}", "units_sold": i + p, "inventory_level": 9 * i}
        for i in range(20) for p in range(3) for s in range(2)]


def test_reports_are_written_and_errors_noted(spark, star, tmp_path, monkeypatch):
    def broken(tables):
        raise ValueError("no such column\nmore")

    monkeypatch.setitem(suite.CATALOGUE, "broken", broken)
    tables, out = star(ROWS), f"file://{tmp_path}/reports"
    names = ["q3_reorder_points", "broken", "q5_kpi_summary", "e1_stock_levels"]
    for _ in range(2):  # a second run replaces the first
        outcomes = suite.run_suite(tables, out, names)
    assert [(o.name, o.rows, o.error) for o in outcomes] == [
        ("q3_reorder_points", 6, None), ("broken", None, "no such column\nmore"),
        ("q5_kpi_summary", 1, None), ("e1_stock_levels", 3, None)]
    assert sorted(p.name for p in (tmp_path / "reports").iterdir() if not p.name.startswith(".")) == [
        "e1_stock_levels.csv", "q3_reorder_points", "q5_kpi_summary.csv"]
    assert (tmp_path / "reports/e1_stock_levels.csv").is_file()
    report = spark.read.option("header", True).csv(f"{out}/e1_stock_levels.csv")
    assert report.columns == ["Category", "Product ID", "Region", "Total_Current_Stock", "Avg_Daily_Stock"]
    assert report.count() == 3


def test_a_second_run_does_what_is_missing(spark, star, tmp_path, monkeypatch):
    ran, failing = [], {"second"}

    def named(name):
        def analysis(tables):
            ran.append(name)
            if name in failing:
                raise ValueError("out of space")
            return tables.fact.select("store_id")

        return analysis

    names = ["first", "second", "third"]
    for name in names:
        monkeypatch.setitem(suite.CATALOGUE, name, named(name))
    tables, out = star(ROWS), f"file://{tmp_path}/again"
    got = suite.run_suite(tables, out, names, resume="load 1")
    assert [(o.rows, o.error) for o in got] == [(120, None), (None, "out of space"), (120, None)]
    ran.clear()
    failing.clear()
    got = suite.run_suite(tables, out, names, resume="load 1")
    assert ran == ["second"] and [(o.rows, o.error) for o in got] == [(120, None)] * 3
    ran.clear()
    suite.run_suite(tables, out, names, resume="load 2")
    assert sorted(ran) == sorted(names)
    ran.clear()
    suite.run_suite(tables, out, names)
    assert sorted(ran) == sorted(names)


def test_reports_overlap(spark, star, tmp_path, monkeypatch):
    both = threading.Barrier(2, timeout=60)
    pools = []

    def waits(tables):
        both.wait()
        pools.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return tables.fact.select("store_id")

    for name in ("one", "two"):
        monkeypatch.setitem(suite.CATALOGUE, name, waits)
    got = suite.run_suite(star(ROWS), f"file://{tmp_path}/both", ["one", "two"], at_once=2)
    assert [o.error for o in got] == [None, None] and sorted(pools) == ["one", "two"]


@pytest.mark.parametrize("name", sorted(suite.SINGLE_FILE))
def test_single_files_are_of_known_reports(name):
    assert name in suite.CATALOGUE


def test_shared_folder_is_the_named_one(spark):
    # The folder that setCheckpointDir chose comes before the setting: Spark itself uses that one.
    folder = shared_folder(spark)
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    assert folder == named.rstrip("/") and shared_folder(spark) == folder
    assert new_folder(spark, "x").startswith(folder) and new_folder(spark, "x") != new_folder(spark, "x")


def test_unnamed_shared_folder_of_a_local_session():
    class Context:
        master = "local[2]"
        chosen = None

        def getCheckpointDir(self):
            return self.chosen

        def setCheckpointDir(self, folder):
            self.chosen = folder

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    folder = shared_folder(Session())
    assert folder.startswith("file:///") and shared_folder(Session()) == folder


def test_unnamed_shared_folder_is_refused_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
