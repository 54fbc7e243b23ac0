"""Which stocks to follow, and how far back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.text import company_name, ticker_keyword
from murmur.operators.dedup import keep_first
from murmur.params import LOOKBACK_OTHER, LOOKBACK_TRENDING


def take_until_repeat(rows: DataFrame, key: str = "ticker", pos: str = "pos") -> DataFrame:
    """Rows in ``pos`` order up to the first key seen before, that row excluded.

    A screen starts over after its last page; the repeat marks the end.
    """
    seen = F.row_number().over(Window.partitionBy(key).orderBy(pos))
    again = rows.select(key, pos, seen.alias("_seen")).where(F.col("_seen") == 2).agg(F.min(pos).alias("at"))
    return rows.where(F.coalesce(F.col(pos) < again.scalar(), F.lit(True)))


def normalize_company(stocks: DataFrame, symbol: str = "symbol", title: str = "title") -> DataFrame:
    """Add the cleaned company name, and the ticker in capitals as keyword."""
    return stocks.withColumns(
        {
            symbol: F.trim(F.col(symbol)),
            "name": company_name(F.col(title)),
            "keyword": ticker_keyword(F.col(symbol)),
        }
    )


def universe_merge(*lists: tuple[DataFrame, bool]) -> DataFrame:
    """Stocks of several lists, each with whether its list is the trending one.

    A list has ``pos``, ``symbol``, ``name``, ``keyword``. The first list a
    stock is on decides whether it is trending, the last one its name and
    keyword; within a list the first position counts.
    """
    tagged = [
        stocks.select(F.lit(number).alias("list_no"), "pos", "symbol", "name", "keyword", F.lit(flag).alias("is_trending"))
        for number, (stocks, flag) in enumerate(lists)
    ]
    every = reduce(DataFrame.unionByName, tagged)
    one_each = keep_first(every, ["symbol", "list_no"], ["pos"])
    first_list = F.struct("list_no", "is_trending")
    last_list = F.struct("list_no", "name", "keyword")
    return (
        one_each.groupBy("symbol")
        .agg(F.min(first_list).alias("_first"), F.max(last_list).alias("_last"))
        .select("symbol", "_first.is_trending", "_last.name", F.array("_last.keyword").alias("keywords"))
    )


def universe_except(universe: DataFrame, rejected: DataFrame, key: str = "symbol") -> DataFrame:
    return universe.join(rejected.select(key), key, "left_anti")


def with_lookback(
    stocks: DataFrame, trending: DataFrame, hours: tuple[int, int] = (LOOKBACK_TRENDING, LOOKBACK_OTHER)
) -> DataFrame:
    """Add the hours to look back: fewer for trending stocks, which are busier."""
    flags = trending.select("stock", "is_trending")
    return stocks.join(flags, "stock", "left").withColumn(
        "lookback", F.when(F.col("is_trending"), F.lit(hours[0])).otherwise(F.lit(hours[1]))
    )


def posts_in_lookback(
    posts: DataFrame,
    lookback: DataFrame,
    now: Column,
    *,
    ts: str = "ts",
    reddit_hours: int = LOOKBACK_TRENDING,
) -> DataFrame:
    """Posts of each stock's own ``[now - lookback, now)``.

    Reddit is fetched once for all stocks and always has the trending hours.
    The longest lookback gives the scan a range, ahead of the join that narrows
    it.
    """
    hours = F.when(F.col("source") == "reddit", F.lit(reddit_hours)).otherwise(F.col("lookback"))
    longest = lookback.agg(F.max("lookback").cast("int")).scalar()
    oldest = now - F.make_dt_interval(F.lit(0), F.greatest(longest, F.lit(reddit_hours)))
    return (
        posts.where((F.col(ts) >= oldest) & (F.col(ts) < now))
        .join(lookback.select("stock", "lookback"), "stock")
        .where(F.col(ts) >= now - F.make_dt_interval(F.lit(0), hours))
    )
