"""Data-quality checks: the storage constraints of the model, counted by Spark jobs.

Each check returns rows (check, violations); 0 means the constraint holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.model import STAR_TABLES, TEXT_LIMITS, Tables
from shelfsight.workspace import written

FACT = "fact_inventory_daily"
FACT_KEY = ("txn_date", "store_id", "product_id")

DIMENSION_KEYS = [
    ("dim_date", "date_key"),
    ("dim_product", "product_id"),
    ("dim_store", "store_id"),
    ("dim_region", "region_id"),
    ("dim_region", "region_name"),
]

FOREIGN_KEYS = [
    ("txn_date", "dim_date", "date_key"),
    ("store_id", "dim_store", "store_id"),
    ("product_id", "dim_product", "product_id"),
    ("region_id", "dim_region", "region_id"),
]

# Check name and the SQL condition of a row that breaks it.
FACT_RANGES = {
    "inventory_level >= 0": "inventory_level < 0",
    "units_sold >= 0": "units_sold < 0",
    "discount_pct in 0..100": "discount_pct < 0 OR discount_pct > 100",
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _count_in_one_pass(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows meeting each condition, all counted in one scan and turned into rows."""
    counted = df.agg(
        *[F.count(F.when(bad, F.lit(1))).alias(f"c{i}") for i, bad in enumerate(conditions.values())]
    )
    lines = [
        F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("violations"))
        for i, name in enumerate(conditions)
    ]
    return counted.select(F.inline(F.array(*lines)))


def repeated_keys(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Key values found on more than one row, with their row count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def suspected_rows(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The keys of rows whose 64-bit key hash occurs more than once, among them all repeated keys. Hashes alone are
    shuffled for all rows; the table of repeated ones is written, so that Spark knows its size when it joins."""
    hashed = df.select(*key, F.xxhash64(*key).alias("key_hash"))
    seen = hashed.groupBy("key_hash").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    return hashed.join(written(seen.select("key_hash"), "key-hashes"), "key_hash", "left_semi").select(*key)


def _key_check(df: DataFrame, table: str, key: tuple[str, ...]) -> DataFrame:
    name = f"{table}({', '.join(key)})"
    return repeated_keys(df, key).agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(name).alias("check"), "violations"
    )


def fact_key_unique(tables: Tables) -> DataFrame:
    """Number of (date, store, product) keys that occur more than once: candidates by hash, then whole keys."""
    return _key_check(suspected_rows(tables.fact, FACT_KEY), FACT, FACT_KEY)


def dimension_keys_unique(tables: Tables) -> DataFrame:
    """Repeated dimension keys: a date with two seasons, a product with two categories."""
    return _union(
        [_key_check(tables.table(table), table, (key,)) for table, key in DIMENSION_KEYS]
    )


def orphan_keys(tables: Tables, column: str, dimension: str, key: str) -> DataFrame:
    """Fact key values without a dimension row, with the number of fact rows.

    The fact is reduced to its distinct keys before the join, so a frequent key is one
    row in it.
    """
    used = (
        tables.fact.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(key))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return used.join(tables.table(dimension), key, "left_anti")


def foreign_keys(tables: Tables) -> DataFrame:
    """Fact rows whose key has no dimension row, per foreign key.

    One scan gives all key values with their kind, counted map-side before they shuffle; they meet the keys of all
    dimensions in one join.
    """
    def keys(pairs: list[tuple[int, str]]) -> Column:
        parts = [F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in pairs]
        return F.inline(F.array(*parts))

    used = (
        tables.fact.select(keys([(kind, column) for kind, (column, _, _) in enumerate(FOREIGN_KEYS)]))
        .filter(F.col("value").isNotNull())
        .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("rows"))
    )
    known = _union(
        [
            tables.table(dimension).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("value"))
            for kind, (_, dimension, key) in enumerate(FOREIGN_KEYS)
        ]
    )
    orphans = used.join(known, ["kind", "value"], "left_anti")
    counted = orphans.agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rows"))), F.lit(0)).alias(f"c{k}") for k in range(len(FOREIGN_KEYS))]
    )
    lines = [
        F.struct(F.lit(f"{column} -> {dimension}.{key}").alias("check"), F.col(f"c{k}").alias("violations"))
        for k, (column, dimension, key) in enumerate(FOREIGN_KEYS)
    ]
    return counted.select(F.inline(F.array(*lines)))


def value_ranges(tables: Tables) -> DataFrame:
    return _count_in_one_pass(
        tables.fact, {name: F.expr(broken) for name, broken in FACT_RANGES.items()}
    )


def rows_out_of_range(tables: Tables) -> DataFrame:
    """The fact rows value_ranges counts."""
    return tables.table(FACT).filter(" OR ".join(FACT_RANGES.values()))


def nulls(tables: Tables) -> DataFrame:
    """Missing values per column of staging and star schema, one pass per table."""
    checks = []
    for name in ("staging_inventory", *STAR_TABLES):
        df = tables.table(name)
        checks.append(
            _count_in_one_pass(df, {f"{name}.{c}": F.col(c).isNull() for c in df.columns})
        )
    return _union(checks)


def dropped_rows(tables: Tables) -> DataFrame:
    """Staging rows that the fact leaves out because no region matches. Counted per region
    first, so a join of a few names is left."""
    counted = tables.staging.groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
    lost = counted.join(tables.dim_region, counted["region"] == tables.dim_region["region_name"], "left_anti")
    return lost.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")).select(
        F.lit("staging rows without a region").alias("check"), "violations"
    )


def violations(tables: Tables) -> list[tuple[str, int]]:
    """Every broken constraint with its count; empty if all hold. A handful of rows."""
    checks = (
        fact_key_unique, dimension_keys_unique, foreign_keys, value_ranges, nulls, text_lengths, dropped_rows,
    )
    found = []
    for check in checks:
        found += [(r["check"], r["violations"]) for r in check(tables).filter("violations > 0").collect()]
    return found


def text_lengths(tables: Tables) -> DataFrame:
    """Texts above the declared length per column, one pass per table."""
    return _union(
        [
            _count_in_one_pass(
                tables.table(name),
                {f"{name}.{c} <= {n}": F.length(c) > n for c, n in limits.items()},
            )
            for name, limits in TEXT_LIMITS.items()
        ]
    )
