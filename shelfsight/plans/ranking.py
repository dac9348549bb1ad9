"""Rank, share and running total over one global descending order.

A window without partition keys brings all rows to one task. Here the rows are dealt into ranges of (value, ties) with
bounds drawn from their distribution, so that even rows of one equal value spread over many, and written once: the
number of a row's range is a partition, and must stay as it is. Each range is worked on by itself; what precedes it
comes from one row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.functions.numeric import EXACT
from shelfsight.workspace import written


def with_descending_order(df: DataFrame, value: str, ties: list[str]) -> DataFrame:
    """Add to every row, by ``value`` descending (NULL last):

    ``rank``: 1 plus the number of rows with a greater value;
    ``running``: sum of ``value`` up to and including the row, equal values by ``ties``;
    ``total`` and ``row_total``: sum of ``value`` and number of rows over all.

    ``value`` is a bigint, money in hundredths, and (value, *ties) unique; sums are exact
    decimals. ``df`` is computed once, when this is called.
    """
    order = [F.desc_nulls_last(value), *[F.asc_nulls_first(c) for c in ties]]
    # The id of a row of a sorted partition holds the partition's number and the row's place in it.
    ranged = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        "ranges",
    )
    offsets, rows, total = _range_offsets(ranged, value)

    def of_range(item: int, kind: str) -> str:
        texts = ", ".join(f"{n}L, {'NULL' if line[item] is None else line[item]}" for n, line in offsets.items())
        return f"CAST(map({texts})[{RANGE}] AS {kind})"

    amount, by_range = f"CAST({value} AS {EXACT})", f"PARTITION BY {RANGE} ORDER BY {value} DESC NULLS LAST"
    running = f"SUM({amount}) OVER (PARTITION BY {RANGE} ORDER BY place ROWS UNBOUNDED PRECEDING)"
    rank = f"{of_range(0, 'BIGINT')} + RANK() OVER ({by_range})"
    if any(line[3] is not None for line in offsets.values()):
        carried = of_range(3, "BIGINT")
        rank = f"IF({carried} IS NOT NULL AND {value} <=> {of_range(2, 'BIGINT')}, {carried}, {rank})"
    before = of_range(1, EXACT)
    # A sum over NULLs only is NULL, as in a plain window at the head of the list.
    return ranged.selectExpr(
        *(f"`{c}`" for c in df.columns),
        f"{rank} AS rank",
        f"COALESCE({before} + {running}, {running}, {before}) AS running",
        f"CAST({'NULL' if total is None else total} AS {EXACT}) AS total",
        f"{rows}L AS row_total",
    )


#: Number of the range of a row, and the row's place in it, from the written id.
RANGE = "shiftright(place, 33)"
PLACE = "(place & 8589934591L)"


def _range_offsets(ranged: DataFrame, value: str) -> tuple[dict[int, tuple], int, int | None]:
    """For each range the rows and the sum before it, the last value of the ranges before, and that value's rank; rows
    and sum of all. One row per range comes to the driver, of which there are as many as shuffle partitions."""
    lines = ranged.groupBy(F.expr(RANGE).alias("range_id")).agg(
        F.expr("count(*)").alias("n"),
        F.expr(f"sum(CAST({value} AS {EXACT}))").alias("s"),
        # The range's last value and where it begins; NULL lies behind all others.
        F.expr(f"min(struct({value} IS NOT NULL AS known, {value} AS value, {PLACE} AS at))").alias("last"),
    )
    offsets, rows, total, last, rank = {}, 0, None, None, None
    for line in sorted(lines.collect(), key=lambda x: x["range_id"]):
        offsets[line["range_id"]] = rows, total, last, rank
        # A range that only continues the value of the one before has no rank of its own.
        if not (line["last"]["at"] == 0 and rank is not None and line["last"]["value"] == last):
            rank = rows + line["last"]["at"] + 1
        rows, last = rows + line["n"], line["last"]["value"]
        if line["s"] is not None:
            total = (total or 0) + line["s"]
    return offsets or {0: (0, None, None, None)}, rows, total


def percent_rank():
    """Relative rank in [0, 1] of rows from with_descending_order; 0 for a lone row."""
    others = F.nullif(F.col("row_total") - 1, F.lit(0))
    return F.coalesce((F.col("rank") - 1).cast("double") / others.cast("double"), F.lit(0.0))


def class_by(share, limits: tuple[float, float], labels: tuple[str, str, str]):
    first, second = limits
    return (
        F.when(share <= F.lit(float(first)), labels[0])
        .when(share <= F.lit(float(second)), labels[1])
        .otherwise(labels[2])
    )
