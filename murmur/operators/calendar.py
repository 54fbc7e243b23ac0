"""Days the market is open, and the lookback they ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions.labels import extra_lookback_hours


def open_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Rows whose ``date`` is not a holiday."""
    return days.join(holidays.select("date"), "date", "left_anti")


def holiday_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Rows whose ``date`` is a holiday."""
    return days.join(holidays.select("date"), "date", "left_semi")


def lookback_hours(days: DataFrame, holidays: DataFrame, base: int = 0) -> DataFrame:
    """Add ``hours``: the base, and more after a weekend or a holiday."""
    after = holidays.select(F.date_add("date", 1).alias("date"), F.lit(True).alias("_after")).distinct()
    marked = days.join(after, "date", "left")
    hours = extra_lookback_hours(F.col("date"), F.col("_after").isNotNull()) + base
    return marked.withColumn("hours", hours).drop("_after")
