"""The modelled tables as Parquet: written once, read by every analysis.

A load writes all its tables to a version folder of its own and then switches one pointer file to it, so the folder holds
a whole load or the one before, whatever fails on the way.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsight.functions.calendar import month_key
from shelfsight.model import PARTITION, SCHEMAS, Tables
from shelfsight.operators import loading
from shelfsight.plans.summaries import SUMMARIES, day_totals, pair_months, summary_schema
from shelfsight.workspace import (
    delete, discard, exists, listed, new_folder, partitions_for, read_text, replace_text,
)

#: The pointer file of a folder: its text is the name of the version folder beside it.
POINTER = "CURRENT"
VERSION = "version-"


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = summary_schema(spark, name) if name in SUMMARIES else SCHEMAS[name]
    if name == "fact_inventory_daily":
        schema = T.StructType([*schema.fields, T.StructField(PARTITION, T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def persist_star_schema(staging: DataFrame, folder: str) -> Tables:
    """Write staging, dimensions, fact, product list and summaries below ``folder``, replacing what
    is there, and return the tables as read back.

    The source is parsed once and parked in the shared folder. From there the staging
    table is range-partitioned by month, product, store and date: a heavy month or product
    spreads over several tasks, and the days of a product and of a (store, product) pair
    lie together, so later aggregations shrink a month of rows before they shuffle. The
    fact follows that order row by row and needs no shuffle of its own.

    Until the last table is written readers open the load before; of older versions that one is kept, for analyses
    that still read it. What a failed load left goes with the next one. One load at a time may write to a folder.
    """
    spark = staging.sparkSession
    version = f"{VERSION}{uuid.uuid4().hex}"
    target = f"{folder}/{version}"

    def put(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        df.write.partitionBy(*partition_by).parquet(f"{target}/{name}")
        return _read(spark, target, name)

    parked = new_folder(spark, "parsed")
    staging.write.parquet(parked)
    order = [month_key(F.col("txn_date")), "product_id", "store_id", "txn_date"]
    staged = put(
        spark.read.schema(staging.schema)
        .parquet(parked)
        .repartitionByRange(partitions_for(spark, parked), *order)
        .sortWithinPartitions(*order),
        "staging_inventory",
    )
    regions = put(loading.build_dim_region(staged), "dim_region")
    jobs = [
        lambda: put(loading.build_fact(staged, regions), "fact_inventory_daily", PARTITION),
        lambda: put(pair_months(staged), "pair_months"),
        lambda: put(day_totals(staged), "day_totals"),
        lambda: put(loading.build_dim_date(staged), "dim_date"),
        lambda: put(loading.build_dim_product(staged), "dim_product"),
        lambda: put(loading.build_dim_store(staged), "dim_store"),
        lambda: put(loading.first_seen_products(staged), "products"),
    ]
    # Independent of each other: the small jobs run beside the fact's.
    with ThreadPoolExecutor(len(jobs)) as pool:
        for job in [pool.submit(job) for job in jobs]:
            job.result()
    discard(spark.read.schema(staging.schema).parquet(parked))
    before = current_version(spark, folder)
    replace_text(spark, f"{folder}/{POINTER}", version)
    for name in listed(spark, folder):
        if name.startswith(VERSION) and name not in (version, before):
            delete(spark, f"{folder}/{name}")
    return open_star_schema(spark, folder)


def current_version(spark: SparkSession, folder: str) -> str | None:
    """Name of the version folder that holds the last whole load, or None."""
    pointer = f"{folder}/{POINTER}"
    return read_text(spark, pointer).strip() if exists(spark, pointer) else None


def open_star_schema(spark: SparkSession, folder: str) -> Tables:
    """Tables of the last whole load by persist_star_schema, with their declared schemas."""
    version = current_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"{folder}: no whole load")

    def read(name: str) -> DataFrame:
        return _read(spark, f"{folder}/{version}", name)

    return Tables(
        staging=read("staging_inventory"),
        dim_date=read("dim_date"),
        dim_product=read("dim_product"),
        dim_store=read("dim_store"),
        dim_region=read("dim_region"),
        fact=read("fact_inventory_daily"),
        products=read("products"),
        pair_months=read("pair_months"),
        day_totals=read("day_totals"),
    )
