"""News records: landed JSON to a table partitioned by ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.params import NEWS_COLUMNS

NEWS_SCHEMA = (
    "category STRING, datetime BIGINT, headline STRING, id BIGINT, image STRING, "
    "related STRING, source STRING, summary STRING, url STRING"
)


def read_news_json(spark: SparkSession, path: str) -> DataFrame:
    """News landed as one JSON record per line, in folders ``ticker=...``."""
    return parse_news(spark.read.schema("value STRING, ticker STRING").text(path))


def parse_news(lines: DataFrame) -> DataFrame:
    """Records from lines (value, ticker).

    A record that lacks any of the nine keys is left out; a key may be null.
    """
    needed = F.array(*[F.lit(name) for name in NEWS_COLUMNS])
    complete = F.size(F.array_except(needed, F.json_object_keys("value"))) == 0
    return lines.where(complete).select("ticker", F.from_json("value", NEWS_SCHEMA).alias("r")).select("ticker", "r.*")


def write_news(news: DataFrame, path: str) -> None:
    """Replace the tables of the tickers in ``news``, leave the others alone.

    Rows are brought together by ticker first, or every task would write a
    file for every ticker; adaptive execution splits a ticker that is large.
    """
    (
        news.hint("rebalance", "ticker")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ticker")
        .parquet(path)
    )


def read_news(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.createDataFrame([], NEWS_SCHEMA + ", ticker STRING").schema
    return spark.read.schema(schema).parquet(path).select("ticker", *NEWS_COLUMNS)


def with_timestamp(news: DataFrame) -> DataFrame:
    """Epoch seconds to a time-zone-free timestamp, the form sessions use."""
    return news.withColumn("ts", F.timestamp_seconds("datetime").cast("timestamp_ntz"))
