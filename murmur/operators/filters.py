"""Row filters on text, language and screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.numbers import market_cap
from murmur.functions.text import clean_headline, clean_post, text_digest
from murmur.operators.dedup import dedup_headlines
from murmur.params import LENIENT_LANGS, MIN_CAP, SHORT_LEVEL, SHORT_LEVELS, STRICT_LANG


def keep_english_lenient(
    posts: DataFrame, *, lang: str = "lang", text: str = "text", exempt: tuple[str, ...] = ()
) -> DataFrame:
    """English posts, and those that a cashtag made look Polish; no empty text.

    Posts of the sources in ``exempt`` all stay.
    """
    english = F.col(lang).isin(*LENIENT_LANGS) & (F.col(text) != "")
    return posts.where(F.col("source").isin(*exempt) | english if exempt else english)


def keep_english_strict(news: DataFrame, *, lang: str = "lang") -> DataFrame:
    return news.where(F.col(lang) == STRICT_LANG)


def drop_foreign_headlines(news: DataFrame, *, lang: str = "lang", headline: str = "headline") -> DataFrame:
    """Drop by value: a headline found non-English anywhere in its ticker's
    table goes, along with every row that carries the same headline."""
    marked = news.withColumn("_digest", text_digest(F.col(headline)))
    is_foreign = F.coalesce(F.col(lang) != STRICT_LANG, F.lit(True))
    foreign = marked.where(is_foreign).select("ticker", "_digest").distinct()
    return marked.join(foreign, ["ticker", "_digest"], "left_anti").select(*news.columns)


def clean_and_drop_empty(posts: DataFrame, text: str = "text") -> DataFrame:
    """Clean the text; a post left empty goes, one left as a space stays.

    Cleaning puts a space for all it takes out, so only an empty text ends
    empty. The test is therefore made on the raw text: it reaches the scan,
    and no text is cleaned twice.
    """
    return posts.where(F.col(text) != "").withColumn(text, clean_post(F.col(text)))


def drop_blank_news(news: DataFrame, *columns: str) -> DataFrame:
    """Drop news whose headline or time is missing or only spaces."""
    for name in columns or ("headline", "datetime"):
        news = news.where(F.col(name).isNotNull() & (F.trim(F.col(name).cast("string")) != ""))
    return news


def clean_news(news: DataFrame, *, order: str = "id", time: str = "datetime") -> DataFrame:
    """Drop blanks, keep the first of equal headlines per ticker, then clean.

    Headlines that become equal only by cleaning all stay.
    """
    kept = dedup_headlines(drop_blank_news(news, "headline", time), order)
    return kept.withColumn("headline", clean_headline(F.col("headline")))


def keep_min_cap(stocks: DataFrame, cap_text: str = "cap_text", minimum: float = MIN_CAP) -> DataFrame:
    """Stocks with a readable market cap of at least ``minimum``."""
    return stocks.withColumn("cap", market_cap(F.col(cap_text))).where(F.col("cap") >= minimum)


def keep_shorted(stocks: DataFrame, short_pct: str = "short_pct", level: int = SHORT_LEVEL) -> DataFrame:
    """Stocks with at least ``level`` percent of the float sold short."""
    if level not in SHORT_LEVELS:
        raise ValueError(f"short level must be one of {SHORT_LEVELS}, not {level}")
    return stocks.where(F.col(short_pct) >= level)


def enough_comments(metrics: DataFrame, minimum: int | Column) -> DataFrame:
    return metrics.where(F.col("total_nb") > minimum)
