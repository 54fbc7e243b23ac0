"""Aggregates of scored posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.params import HISTOGRAM_BINS, SOURCES


def _per_source() -> list[Column]:
    out = []
    for source in SOURCES:
        here = F.col("source") == source
        out.append(F.avg(F.when(here, F.col("probability"))).alias(f"avg_{source}"))
        out.append(F.count(F.when(here, F.lit(1))).alias(f"nb_{source}"))
    return out


def _long(posts: DataFrame, prefix: str, name: str) -> DataFrame:
    """One row per (stock, source), sources without posts included."""
    wide = posts.groupBy("stock").agg(*_per_source())
    columns = [F.col(f"{prefix}_{source}").alias(source) for source in SOURCES]
    return wide.select("stock", *columns).unpivot("stock", list(SOURCES), "source", name)


def nb_comments(posts: DataFrame) -> DataFrame:
    """Posts per stock and source, 0 when there are none."""
    return _long(posts, "nb", "nb")


def average_sentiment(posts: DataFrame) -> DataFrame:
    """Mean sentiment per stock and source, NULL when there are no posts."""
    return _long(posts, "avg", "avg")


def stock_sentiment_metrics(posts: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """One row per stock: totals, then mean and count for each source.

    One hash aggregate with map-side partial sums. The total mean is over
    posts, not over the sources' means. With ``universe`` every stock of it
    has a row. ``accuracy`` is declared but never filled.
    """
    metrics = posts.groupBy("stock").agg(
        F.avg("probability").alias("total_avg"),
        F.count(F.lit(1)).alias("total_nb"),
        F.lit(None).cast("double").alias("accuracy"),
        *_per_source(),
    )
    if universe is None:
        return metrics
    counts = ["total_nb", *[f"nb_{source}" for source in SOURCES]]
    return universe.select("stock").join(metrics, "stock", "left").fillna(0, counts)


def metrics_rollup(posts: DataFrame) -> DataFrame:
    """The same numbers in long form; the stock's total has a NULL source."""
    return posts.groupingSets([["stock", "source"], ["stock"]], "stock", "source").agg(
        F.count(F.lit(1)).alias("nb"), F.avg("probability").alias("avg")
    )


def directional_accuracy(posts: DataFrame) -> DataFrame:
    """Per stock, the share of tagged Stocktwits posts whose tag agrees with
    the sign of the score. An extension: the published column stays empty."""
    bull = F.contains("directional", F.lit("Bullish"))
    bear = F.contains("directional", F.lit("Bearish"))
    agrees = (bull & (F.col("probability") > 0)) | (bear & (F.col("probability") < 0))
    tagged = posts.where((F.col("source") == "stocktwit") & (bull | bear))
    return tagged.groupBy("stock").agg(
        F.count(F.lit(1)).alias("nb_tagged"), F.avg(agrees.cast("int")).alias("accuracy")
    )


def return_sentiment_corr(sessions: DataFrame) -> DataFrame:
    """Per ticker, the correlation of daily return and sentiment."""
    pair = F.col("daily_return").isNotNull() & F.col("sentiment").isNotNull()
    return sessions.groupBy("ticker").agg(
        F.count(F.when(pair, F.lit(1))).alias("nb"), F.corr("daily_return", "sentiment").alias("corr")
    )


def sentiment_histogram(scores: DataFrame, score: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal-width bins from the least to the greatest score.

    Every bin has a row; the last one is closed. When all scores are equal
    the range is widened by a half on both sides.
    """
    known = scores.where(F.col(score).isNotNull()).select(F.col(score).alias("x"))
    least, most = F.min("x"), F.max("x")
    half = F.when(least == most, F.lit(0.5)).otherwise(F.lit(0.0))
    ends = known.agg(F.struct((least - half).alias("lo"), (most + half).alias("hi")).alias("ends")).scalar()

    share = (F.col("x") - F.col("ends.lo")) / (F.col("ends.hi") - F.col("ends.lo"))
    place = F.least(F.floor(share * bins), F.lit(bins - 1))
    counted = known.withColumn("ends", ends).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    spine = scores.sparkSession.range(bins).select(F.col("id").alias("bin"), ends.alias("ends"))
    width = (F.col("ends.hi") - F.col("ends.lo")) / bins
    return (
        spine.where(F.col("ends.lo").isNotNull())
        .join(counted, "bin", "left")
        .select(
            "bin",
            (F.col("ends.lo") + F.col("bin") * width).alias("left_edge"),
            (F.col("ends.lo") + (F.col("bin") + 1) * width).alias("right_edge"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        )
    )
