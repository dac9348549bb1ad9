from __future__ import annotations

from conftest import day

from shelfsight.operators.production import reorder_points
from shelfsight.streaming.alerts import ALERT_SCHEMA, daily_rows, read_alerts, reorder_alerts, write_alerts
from shelfsight.workspace import written

HISTORY = [{"txn_date": day(i), "store_id": s, "units_sold": n} for s in ("S1", "S2") for i, n in enumerate([8, 12])]
NEW = [{"txn_date": day(2 + i), "store_id": s, "inventory_level": n}
       for i in range(3) for s, n in (("S1", 40 * i), ("S2", 500), ("S9", 0))]


def _key(rows):
    return sorted((r.txn_date, r.store_id, r.product_id, r.on_hand, r.reorder_point, r.status) for r in rows)


def test_stream_gives_the_batch_alerts_once(spark, star, staging, tmp_path):
    levels = written(reorder_points(star(HISTORY)), "levels")
    inbox, out, state = (str(tmp_path / x) for x in ("inbox", "out", "state"))
    staging(NEW).write.parquet(inbox)
    write_alerts(reorder_alerts(daily_rows(spark, inbox), levels), out, state).awaitTermination()
    # A later file repeats known rows and brings one more.
    staging(NEW[:4] + [{"txn_date": day(5), "store_id": "S2", "inventory_level": 3}]).write.mode("append").parquet(inbox)
    write_alerts(reorder_alerts(daily_rows(spark, inbox), levels), out, state).awaitTermination()

    got = _key(read_alerts(spark, out).collect())
    batch = reorder_alerts(spark.read.parquet(inbox), levels)
    assert got == _key(batch.collect())
    assert [(g[1], g[3], g[5]) for g in got] == [
        ("S1", 0, "STOCKOUT"), ("S1", 40, "REORDER NOW"), ("S1", 80, "REORDER NOW"), ("S2", 3, "REORDER NOW")]


def test_late_first_arrivals_and_second_calls_lose_nothing(spark, star, staging, tmp_path):
    """Files out of order, repeated rows, and calls without a checkpoint of their own."""
    levels = written(reorder_points(star(HISTORY)), "levels")
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    for days in ([60], [20, 61], [60, 1], []):
        rows = [{"txn_date": day(d), "store_id": s, "inventory_level": 1} for d in days for s in ("S1", "S2")]
        if rows:
            staging(rows).write.mode("append").parquet(inbox)
        write_alerts(reorder_alerts(daily_rows(spark, inbox), levels), out).awaitTermination()
        batch = reorder_alerts(spark.read.parquet(inbox), levels)
        assert _key(read_alerts(spark, out).collect()) == _key(batch.collect())
    assert spark.read.parquet(out).count() == read_alerts(spark, out).count() == 8


def test_a_revised_row_takes_the_place_of_the_one_before(spark, star, staging, tmp_path):
    """The same date and pair comes again with less, as much and more stock, across calls with and without their state."""
    levels = written(reorder_points(star(HISTORY)), "levels")
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    for call, stock in enumerate([20, 0, 0, 35, 60]):
        rows = [{"txn_date": day(2), "store_id": "S1", "inventory_level": stock},
                {"txn_date": day(2), "store_id": "S2", "inventory_level": 30 - call},
                {"txn_date": day(3 + call), "store_id": "S1", "inventory_level": 7}]
        staging(rows).write.mode("append").parquet(inbox)
        state = str(tmp_path / f"state-{call // 2}")  # a new state reads all files again
        write_alerts(reorder_alerts(daily_rows(spark, inbox), levels), out, state).awaitTermination()
        batch = reorder_alerts(spark.read.parquet(inbox), levels)
        assert batch.schema.simpleString() == ALERT_SCHEMA.simpleString()
        assert _key(read_alerts(spark, out).collect()) == _key(batch.collect())
    first = [r for r in _key(read_alerts(spark, out).collect()) if r[:2] == (day(2), "S1")]
    assert [(r[3], r[5]) for r in first] == [(0, "STOCKOUT")]


def test_files_of_other_dates_are_not_opened(spark, star, staging, tmp_path):
    levels = written(reorder_points(star(HISTORY)), "levels")
    inbox, out = str(tmp_path / "inbox"), tmp_path / "out"
    staging([{"txn_date": day(2), "inventory_level": 5}, {"txn_date": day(3), "inventory_level": 5}]).write.parquet(inbox)
    write_alerts(reorder_alerts(daily_rows(spark, inbox), levels), str(out)).awaitTermination()
    for path in (out / f"txn_date={day(2)}").glob("*.parquet"):
        path.write_bytes(b"no parquet")
        (path.parent / f".{path.name}.crc").unlink()
    staging([{"txn_date": day(3), "inventory_level": 1}, {"txn_date": day(4), "inventory_level": 2}]).write.mode("append").parquet(inbox)
    query = write_alerts(reorder_alerts(daily_rows(spark, inbox), levels), str(out))
    query.awaitTermination()
    got = read_alerts(spark, str(out)).where(f"txn_date >= DATE'{day(3)}'")
    assert [(r.txn_date, r.on_hand) for r in got.orderBy("txn_date").collect()] == [(day(3), 1), (day(4), 2)]
