"""Trending lists, landed as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.params import TRENDING_LIMIT

TRENDING_SCHEMA = "symbols ARRAY<STRUCT<symbol: STRING, title: STRING>>"


def flatten_trending(lists: DataFrame, body: Column) -> DataFrame:
    """One record per listed stock, with its position in the list."""
    symbols = F.from_json(body, TRENDING_SCHEMA)["symbols"]
    return lists.select("*", F.posexplode(symbols).alias("pos", "_stock")).select(
        *lists.columns, "pos", F.col("_stock.symbol").alias("symbol"), F.col("_stock.title").alias("title")
    )


def take_trending(stocks: DataFrame, limit: int = TRENDING_LIMIT) -> DataFrame:
    """The first stocks of each list; a repeat counts towards the limit."""
    return stocks.where(F.col("pos") < limit)
