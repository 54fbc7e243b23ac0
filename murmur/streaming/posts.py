"""Posts as they land.

Parsing, the language filter and cleaning need one post at a time, so they run
on a stream as they are. Counts and means of the lookback are windows over the
post time. De-duplication across sources stays a batch step: it needs the
arrival order of whole sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from murmur.functions.language import with_language
from murmur.operators import filters
from murmur.params import LOOKBACK_TRENDING
from murmur.sources.posts import parse_stocktwits, parse_twitter, union_posts

PREPARED = ("stock", "source", "user", "text", "directional", "seq")


def landed_posts(
    spark: SparkSession, path: str, schema: str, *, format: str = "json", files_per_batch: int = 1000
) -> DataFrame:
    """A stream of the files that land in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def prepared_posts(stocktwits: DataFrame, twitter: DataFrame) -> DataFrame:
    """Raw posts to parsed, English, cleaned ones. Keeps no state."""
    searched = union_posts(parse_stocktwits(stocktwits), parse_twitter(twitter))
    english = filters.keep_english_lenient(with_language(searched, "text"))
    return filters.clean_and_drop_empty(english).select(*PREPARED, *[c for c in ("ts",) if c in english.columns])


def write_stream(posts: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append to a table by source; each post is written exactly once.

    ``once`` takes what has landed so far and stops.
    """
    writer = (
        posts.writeStream.format("parquet")
        .partitionBy("source")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def lookback_metrics(
    posts: DataFrame, *, hours: int = LOOKBACK_TRENDING, every: str = "1 hour", late: str = "1 hour"
) -> DataFrame:
    """Per stock and source, count and mean over the last ``hours``, every so often.

    Posts later than ``late`` are left out; a window is final, and its state
    dropped, once the watermark has passed it.
    """
    return (
        posts.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{hours} hours", every), "stock", "source")
        .agg(F.count(F.lit(1)).alias("nb"), F.avg("probability").alias("avg"))
        .select(F.col("window.start").alias("since"), F.col("window.end").alias("until"), "stock", "source", "nb", "avg")
    )
