"""Reorder alerts on newly arriving daily rows.

New staging-shaped files are read as a stream and joined to a static table of reorder points from the batch suite.
Alerts lie in one folder per date and are only ever added to: a row that comes again with less stock adds an alert that
takes the place of the one before when the folder is read. However late a row arrives, its alert counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfsight import params as P
from shelfsight.model import STAGING_SCHEMA
from shelfsight.workspace import discard, listed, written

ROW_KEY = ["txn_date", "store_id", "product_id"]
ALERT_SCHEMA = T.StructType([
    T.StructField("txn_date", T.DateType()), T.StructField("store_id", T.StringType()),
    T.StructField("product_id", T.StringType()), T.StructField("on_hand", T.IntegerType()),
    T.StructField("reorder_point", T.DoubleType()), T.StructField("status", T.StringType()),
])


def daily_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema(STAGING_SCHEMA).parquet(folder)


def reorder_alerts(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows at or below their pair's reorder point.

    ``levels`` holds store_id, product_id and reorder_point; give a written table, as it
    is read again for every micro-batch. Works alike on a stream and on a batch; a batch
    has one alert per date and pair, the one of least stock. On a stream write_alerts
    and read_alerts see to that.
    """
    on_hand = F.col("inventory_level")
    low = (
        rows.select(*ROW_KEY, "inventory_level")
        .join(levels.select("store_id", "product_id", "reorder_point"), ["store_id", "product_id"])
        .filter(on_hand <= F.col("reorder_point"))
        .select(
            *ROW_KEY,
            on_hand.alias("on_hand"),
            "reorder_point",
            F.when(on_hand == 0, P.STOCKOUT).otherwise(P.REORDER_NOW).alias("status"),
        )
    )
    return low if rows.isStreaming else _one_per_key(low)


def _one_per_key(alerts: DataFrame) -> DataFrame:
    rest = [F.min_by(c, "on_hand").alias(c) for c in ("reorder_point", "status")]
    return alerts.groupBy(*ROW_KEY).agg(F.min("on_hand").alias("on_hand"), *rest)


def write_alerts(alerts: DataFrame, folder: str, checkpoint: str | None = None) -> StreamingQuery:
    """Add alerts as Parquet, a folder per date, until all files present are used. read_alerts gives the result.

    An alert is left out if ``folder`` has one of the same date and pair with as little stock; only the folders of the
    batch's dates are read for that. So repeated rows, a batch that runs again after a failure, and a second call
    add nothing, a revised row counts, and no row is too late. Files of a batch that failed half-way are complete
    alerts too, and the batch adds the rest when it runs again. Without a ``checkpoint`` the state lies in ``folder``
    itself, so that both stay together.
    """
    schema = alerts.schema

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = written(_one_per_key(batch).select(*schema.names), "alerts")
        # One row per calendar date: a century is under 40,000.
        dates = {f"txn_date={row[0]}" for row in new.select("txn_date").distinct().collect()}
        present = sorted(dates.intersection(listed(spark, folder)))
        if present:
            paths = [f"{folder}/{name}" for name in present]
            known = spark.read.schema(schema).option("basePath", folder).parquet(*paths)
            least = known.groupBy(*ROW_KEY).agg(F.min("on_hand").alias("least"))
            better = F.col("least").isNull() | (F.col("on_hand") < F.col("least"))
            added = new.join(least, ROW_KEY, "left").where(better).select(*schema.names)
        else:
            added = new
        # A date goes to one file, or to several where it holds many alerts.
        added.hint("rebalance", "txn_date").write.mode("append").partitionBy("txn_date").parquet(folder)
        discard(new)

    return (
        alerts.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint or f"{folder.rstrip('/')}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts in ``folder``, one per date and pair, the one of least stock; filters on txn_date leave other dates'
    files alone."""
    return _one_per_key(spark.read.schema(ALERT_SCHEMA).parquet(folder)).select(*ALERT_SCHEMA.fieldNames())
