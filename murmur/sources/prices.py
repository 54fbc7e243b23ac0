"""Daily price tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_SCHEMA = (
    "ticker STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
    "adj_close DOUBLE, volume BIGINT, dividend DOUBLE, split DOUBLE"
)


def read_prices(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    reader = spark.read.schema(PRICE_SCHEMA)
    return reader.csv(path, header=True) if format == "csv" else reader.parquet(path)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any missing value."""
    return df.na.drop("any")


def in_range(prices: DataFrame, start: Column, end: Column, date: str = "date") -> DataFrame:
    """Rows of the date range, both ends included."""
    return prices.where(F.col(date).between(start, end))


def pick_value(prices: DataFrame, ordinal: int = 4, keys: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """The keys and the value column at ``ordinal``, named ``adj_close``.

    The ordinal counts value columns only: the fifth one by default.
    """
    values = [name for name in prices.columns if name not in keys]
    return prices.select(*keys, F.col(values[ordinal]).alias("adj_close"))


def adjusted_close(prices: DataFrame, start: Column, end: Column) -> DataFrame:
    """Complete rows of the range, reduced to the adjusted close."""
    return pick_value(in_range(drop_incomplete(prices), start, end))
