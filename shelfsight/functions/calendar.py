"""Date attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(day: Column) -> Column:
    """Year and month as one integer, e.g. 202301; the fact's partition column."""
    return F.year(day) * 100 + F.month(day)


def month_label(month: Column) -> Column:
    """Abbreviated English name of a month number."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def date_attributes(day: Column) -> list[Column]:
    """The calendar columns of dim_date, weekdays and weeks by ISO 8601."""
    weekday = F.weekday(day) + 1
    return [
        F.dayofmonth(day).cast("smallint").alias("day"),
        F.month(day).cast("smallint").alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.quarter(day).cast("smallint").alias("quarter"),
        F.year(day).cast("smallint").alias("year"),
        weekday.cast("smallint").alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        weekday.isin(6, 7).alias("is_weekend"),
        F.weekofyear(day).cast("smallint").alias("week_of_year"),
    ]
