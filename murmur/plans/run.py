"""Run a job over a folder of landed data.

    python -m murmur.plans.run social LANDING OUT --now "2024-01-31 00:00:00" --model package.module:loader
    python -m murmur.plans.run news LANDING OUT --start 2024-01-01 --end 2024-01-31

Landed tables, each a folder of its own:

========== ============================================================
trending   the list as JSON, one response per file
screener   JSON lines: page, html
caps       JSON lines: symbol, and cap_text or the html of its statistics page
holidays   CSV: holiday, then one column per year
comments   JSON lines: id, created_utc, body
stocktwits JSON lines: stock, seq, created_utc, raw
twitter    JSON lines: stock, seq, created_utc, raw
positions  CSV: stock, held (optional)
news       JSON lines in folders ``ticker=...``
prices     CSV, see ``sources/prices.py``
lexicon    CSV: token, valence
========== ============================================================
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur import params
from murmur.functions.ngrams import learned_language
from murmur.operators.calendar import holiday_days
from murmur.operators.metrics import return_sentiment_corr, sentiment_histogram
from murmur.operators.scoring import Model
from murmur.operators.signals import position_signal
from murmur.operators.universe import posts_in_lookback, with_lookback
from murmur.operators.valence import Modifiers
from murmur.plans import jobs
from murmur.session import shared_dir
from murmur.sources import html, posts, prices, sinks, trending
from murmur.sources import news as news_source
from murmur.sources.holidays import holidays_long

# What the tag of the statistics table has in it.
STATISTICS_TABLE = r"Bdcl\(c\)"


class MarketClosed(Exception):
    """The day of the run is a market holiday."""


def check_open(spark: SparkSession, landing: str, now: Column) -> None:
    wide = spark.read.csv(f"{landing}/holidays", header=True)
    today = spark.range(1).select(F.to_date(now).alias("date"))
    if not holiday_days(today, holidays_long(wide)).isEmpty():
        raise MarketClosed("the market is closed: the day is a holiday")


def followed_stocks(
    spark: SparkSession,
    landing: str,
    *,
    trending_limit: int | None = params.TRENDING_LIMIT,
    level: int = params.SHORT_LEVEL,
    minimum_cap: float = params.MIN_CAP,
) -> DataFrame:
    """The universe: stock, is_trending, name, keywords, cap.

    Screens are landed for one short ``level``; the page says no more of it.
    """
    if level not in params.SHORT_LEVELS:
        raise ValueError(f"short level must be one of {params.SHORT_LEVELS}, not {level}")
    busy = trending.flatten_trending(spark.read.text(f"{landing}/trending", wholetext=True), F.col("value"))
    if trending_limit is not None:
        busy = trending.take_trending(busy, trending_limit)
    pages = spark.read.schema("page BIGINT, html STRING").json(f"{landing}/screener")
    screen = html.screener_rows(pages, "page").select(
        (F.shiftleft("page", 32) + F.col("row_no")).alias("pos"),  # by page, then by row, however long a page is
        F.col("ticker").alias("symbol"),
        F.col("company").alias("title"),
    )
    caps = spark.read.schema("symbol STRING, cap_text STRING, html STRING").json(f"{landing}/caps")
    caps = html.first_cell_after_label(caps, F.col("html"), "_shown", STATISTICS_TABLE)
    caps = caps.select("symbol", F.coalesce("cap_text", "_shown").alias("cap_text"))
    chosen = jobs.choose_universe(busy.select("pos", "symbol", "title"), screen, caps, minimum_cap=minimum_cap)
    return chosen.withColumnRenamed("symbol", "stock")


def run_social(
    spark: SparkSession,
    landing: str,
    out: str,
    now: Column,
    load_model: Callable[[], Model],
    *,
    lookback: tuple[int, int] = (params.LOOKBACK_TRENDING, params.LOOKBACK_OTHER),
    comment_limit: int | None = None,
    trending_limit: int | None = params.TRENDING_LIMIT,
    level: int = params.SHORT_LEVEL,
    minimum_cap: float = params.MIN_CAP,
    min_comments: int = params.MIN_COMMENTS,
    entry: float = params.ENTRY_SENTIMENT,
    hold: float = params.HOLD_SENTIMENT,
    **options,
) -> None:
    """Metrics of every followed stock, and what to do about each.

    ``comment_limit`` caps the comments of the lookback, oldest first, as a
    fetch of that many would; without it all are taken.
    """
    check_open(spark, landing, now)
    stage = shared_dir(spark, "social")
    stocks = followed_stocks(spark, landing, trending_limit=trending_limit, level=level, minimum_cap=minimum_cap)
    stocks.write.mode("overwrite").parquet(f"{stage}/stocks")
    stocks = spark.read.schema(stocks.schema).parquet(f"{stage}/stocks")

    comments = posts.read_comments(spark, f"{landing}/comments")
    recent = posts.posts_in_window(comments, now, lookback[0])
    if comment_limit is not None:
        recent = posts.cap_posts(recent, limit=comment_limit)
    hours = with_lookback(stocks.select("stock"), stocks, lookback)
    searched = [
        posts_in_lookback(
            posts.read_raw_posts(spark, f"{landing}/{folder}").withColumn("source", F.lit(source)),
            hours,
            now,
            reddit_hours=lookback[0],
        )
        for folder, source in (("stocktwits", "stocktwit"), ("twitter", "twitter"))
    ]
    metrics = jobs.social_sentiment(recent, *searched, stocks, load_model, stage_dir=stage, **options)
    sinks.write_metrics_csv(metrics, f"{out}/metrics")

    held = _read_positions(spark, landing)
    rows = sinks.read_metrics_csv(spark, f"{out}/metrics")
    decided = position_signal(rows, held, min_comments=min_comments, entry=entry, hold=hold)
    decided.write.mode("overwrite").csv(f"{out}/signals", header=True)


def _read_positions(spark: SparkSession, landing: str) -> DataFrame:
    schema = "stock STRING, held STRING"
    try:
        return spark.read.schema(schema).csv(f"{landing}/positions", header=True)
    except AnalysisException:  # no folder: no positions yet
        return spark.createDataFrame([], schema)


def run_news(spark: SparkSession, landing: str, out: str, start: Column, end: Column, **options) -> None:
    """The news tables, returns beside the sentiment of the session before, and how the two go together."""
    news_source.write_news(news_source.read_news_json(spark, f"{landing}/news"), f"{out}/news")
    headlines = news_source.with_timestamp(news_source.read_news(spark, f"{out}/news")).select(
        "ticker", "id", "ts", "headline"
    )
    bars = prices.read_prices(spark, f"{landing}/prices")
    lexicon = spark.read.schema("token STRING, valence DOUBLE").csv(f"{landing}/lexicon", header=True)
    rows = jobs.news_vs_return(headlines, bars, lexicon, start, end, **options)
    rows.write.mode("overwrite").parquet(f"{out}/returns")
    rows = spark.read.schema(rows.schema).parquet(f"{out}/returns")
    return_sentiment_corr(rows).write.mode("overwrite").parquet(f"{out}/correlation")
    sentiment_histogram(rows, "sentiment").write.mode("overwrite").parquet(f"{out}/histogram")


def load_object(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="murmur")
    jobs_ = parser.add_subparsers(dest="job", required=True)
    social = jobs_.add_parser("social")
    news = jobs_.add_parser("news")
    for job in (social, news):
        job.add_argument("landing")
        job.add_argument("out")
    social.add_argument("--now", required=True, help="time of the run, without time zone")
    social.add_argument("--model", required=True, help="module:function that loads the sentiment model")
    social.add_argument("--null-user", choices=("keep", "collapse"), default="keep")
    social.add_argument("--model-tasks", type=int)
    social.add_argument("--language-model", help="module:function that loads a language model")
    for job in (social, news):
        job.add_argument("--language-table", help="folder of a learned language model")
    news.add_argument("--rules", action="store_true", help="score headlines by rules for negation, degree and emphasis")
    for name, kind, default, what in (
        ("lookback-trending", int, params.LOOKBACK_TRENDING, "hours to look back for trending stocks and comments"),
        ("lookback-other", int, params.LOOKBACK_OTHER, "hours to look back for other stocks"),
        ("model-tokens", int, params.MODEL_TOKENS, "tokens of a post that the model gets"),
        ("comment-limit", int, None, "most comments to take; all without it"),
        ("trending-limit", int, params.TRENDING_LIMIT, "most stocks to take from the trending list"),
        ("short-level", int, params.SHORT_LEVEL, "the short level of the landed screen, in percent"),
        ("min-cap", float, params.MIN_CAP, "least market cap in dollars"),
        ("min-comments", int, params.MIN_COMMENTS, "comments a stock needs for a position"),
        ("entry", float, params.ENTRY_SENTIMENT, "mean sentiment in percent from which to enter"),
        ("hold", float, params.HOLD_SENTIMENT, "mean sentiment in percent from which to hold"),
    ):
        social.add_argument(f"--{name}", type=kind, default=default, help=what)
    news.add_argument("--min-headlines", type=int, default=params.MIN_HEADLINES, help="fewest headlines of a session")
    news.add_argument("--start", required=True)
    news.add_argument("--end", required=True)
    given = parser.parse_args(arguments)

    spark = SparkSession.builder.appName(f"murmur {given.job}").getOrCreate()
    language = learned_language(spark.read.parquet(given.language_table)) if given.language_table else None
    if given.job == "social":
        now = F.lit(given.now).cast("timestamp_ntz")
        options = {
            "null_user": given.null_user,
            "model_tasks": given.model_tasks,
            "model_tokens": given.model_tokens,
            "language": language,
            "load_language": load_object(given.language_model) if given.language_model else None,
            "lookback": (given.lookback_trending, given.lookback_other),
            "comment_limit": given.comment_limit,
            "trending_limit": given.trending_limit,
            "level": given.short_level,
            "minimum_cap": given.min_cap,
            "min_comments": given.min_comments,
            "entry": given.entry,
            "hold": given.hold,
        }
        run_social(spark, given.landing, given.out, now, load_object(given.model), **options)
    else:
        days = [F.lit(day).cast("date") for day in (given.start, given.end)]
        run_news(spark, given.landing, given.out, *days, minimum=given.min_headlines, rules=Modifiers() if given.rules else None, language=language)


if __name__ == "__main__":
    main()
