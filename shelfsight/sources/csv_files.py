"""CSV input and CSV reports."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsight.model import MONEY, STAGING_COLUMNS
from shelfsight.workspace import data_files, delete, first_line, listed, replace_file, written

CORRUPT = "_corrupt_record"
# Money is parsed with more decimals than it may have, so that extra ones are seen.
PARSED_MONEY = T.DecimalType(18, 8)


def _header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    line = first_line(spark, path)
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]), ())) if line is not None else ()


def _by_header(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files of ``path`` (a file, folder or pattern) by their own header; only first lines are read here. Files
    without a line are left out."""
    files = data_files(spark, path)
    with ThreadPoolExecutor(32) as pool:
        headers = list(pool.map(lambda name: _header_of(spark, name), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, header in zip(files, headers, strict=True):
        if header:
            groups.setdefault(header, []).append(name)
    if not groups:
        raise ValueError(f"{path}: no file with a header")
    return groups


def _file_schema(path: str, header: tuple[str, ...]) -> T.StructType:
    """Declared types for the known headers, in the order the files have them."""
    kinds = {name: PARSED_MONEY if kind == MONEY else kind for name, _, kind, _ in STAGING_COLUMNS}
    missing = [name for name in kinds if name not in header]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return T.StructType([T.StructField(name, kinds.get(name, T.StringType())) for name in header])


def _too_fine(header: str):
    """Whether a money value has more than two decimals or too many digits."""
    value = F.col(f"`{header}`")
    return value.isNotNull() & ~F.coalesce(value == value.try_cast(MONEY), F.lit(False))


def _renamed(strict: bool) -> list:
    out = []
    for header, name, kind, _ in STAGING_COLUMNS:
        value = F.col(f"`{header}`")
        if kind == MONEY:
            error = F.raise_error(F.concat(F.lit(f"Malformed {header}: "), value.cast("string"))).cast(MONEY)
            value = F.when(_too_fine(header), error if strict else F.lit(None)).otherwise(value.try_cast(MONEY))
        out.append(value.alias(name))
    return out


def load_staging(spark: SparkSession, path: str) -> DataFrame:
    """Typed staging table from CSV with header; one value of the wrong type, or money with more
    than two decimals, ends the load. Files may have their columns in any order and further
    columns; files of one header are read together.

    Spark parses the columns a query selects; persist_star_schema selects them all, so
    no bad value gets past the load.
    """
    parts = [
        spark.read.schema(_file_schema(path, header))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(files)
        .select(*_renamed(strict=True))
        for header, files in _by_header(spark, path).items()
    ]
    return reduce(DataFrame.unionAll, parts)


def load_staging_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Well-typed rows, and the source lines of the others; a line with money of more than
    two decimals is rebuilt from its values. Files are parsed once, those of one header together."""
    parsed = [_parsed_with_rejects(spark, path, header, files) for header, files in _by_header(spark, path).items()]
    kept = written(reduce(DataFrame.unionAll, parsed), "parsed")
    good = kept.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = kept.filter(F.col(CORRUPT).isNotNull())
    return good, bad


def _parsed_with_rejects(spark: SparkSession, path: str, header: tuple[str, ...], files: list[str]) -> DataFrame:
    parsed = (
        spark.read.schema(_file_schema(path, header).add(CORRUPT, T.StringType()))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(files)
    )
    fine = F.lit(False)
    for name, _, kind, _ in STAGING_COLUMNS:
        fine = fine | _too_fine(name) if kind == MONEY else fine
    line = F.when(fine, F.to_csv(F.struct(*(F.col(f"`{c}`") for c in parsed.columns if c != CORRUPT))))
    return (
        parsed.withColumn(CORRUPT, F.coalesce(F.col(CORRUPT), line))
        .select(*_renamed(strict=False), CORRUPT)
    )


def write_report(df: DataFrame, path: str, single: bool = False) -> None:
    """One result as CSV with header: part files in the folder ``path``, or with ``single`` the one file ``path``.csv,
    for results of few rows. Either form takes the place of the other."""
    spark = df.sparkSession
    if not single:
        df.write.mode("overwrite").option("header", True).csv(path)
        delete(spark, f"{path}.csv")
        return
    parts = f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(parts)
    part = next(name for name in listed(spark, parts) if name.startswith("part-"))
    replace_file(spark, f"{parts}/{part}", f"{path}.csv")
    delete(spark, parts)
    delete(spark, path)
