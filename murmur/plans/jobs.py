"""The three jobs, end to end, as one plan each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.language import LanguageModel, detect_language, with_language
from murmur.functions.text import clean_headline, text_digest, words
from murmur.operators import filters, sessions, universe
from murmur.operators.dedup import dedup_headlines, dedup_staged, with_source_order
from murmur.operators.match import keyword_match
from murmur.operators.metrics import stock_sentiment_metrics
from murmur.operators.scoring import Model, lexicon_score, score_by_digest
from murmur.operators.valence import Modifiers, rule_score
from murmur.params import MIN_CAP, MIN_HEADLINES, SHORT_LEVEL
from murmur.sources.posts import parse_stocktwits, parse_twitter, union_posts
from murmur.sources.prices import adjusted_close

_POST_COLUMNS = ("stock", "source", "user", "text", "directional", "seq")


def choose_universe(
    trending: DataFrame,
    screen: DataFrame,
    caps: DataFrame,
    *,
    level: int = SHORT_LEVEL,
    minimum_cap: float = MIN_CAP,
) -> DataFrame:
    """Stocks to follow: trending ones, then shorted ones, less small caps.

    ``trending``: pos, symbol, title. ``screen``: pos, symbol, title, and
    short_pct unless the screen has been filtered by it. ``caps``: symbol,
    cap_text; a stock without a readable cap is left out.
    """
    if "short_pct" in screen.columns:
        screen = filters.keep_shorted(screen, level=level)
    listed = universe.take_until_repeat(screen, "symbol")
    merged = universe.universe_merge(
        (universe.normalize_company(trending), True), (universe.normalize_company(listed), False)
    )
    large = filters.keep_min_cap(caps, minimum=minimum_cap).select("symbol", "cap")
    return merged.join(large, "symbol")


def prepare_posts(
    comments: DataFrame,
    stocktwits: DataFrame,
    twitter: DataFrame,
    stocks: DataFrame,
    load_language: Callable[[], LanguageModel] | None = None,
    language: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Posts of all sources: matched, parsed, English, cleaned, in arrival order.

    ``comments``: seq, body. ``stocktwits`` and ``twitter``: stock, seq, raw.
    ``stocks``: stock, keywords. Reddit is not filtered by language. Where the
    searched posts come with a ``lang``, that stands; else ``language`` says it,
    or ``load_language`` names the model, or stopwords vote.
    """
    reddit = keyword_match(comments, stocks, text="body").select(
        "stock",
        F.lit("reddit").alias("source"),
        F.lit(None).cast("string").alias("user"),
        F.col("body").alias("text"),
        F.lit(None).cast("string").alias("directional"),
        "seq",
    )
    parsed = (parse_stocktwits(stocktwits), parse_twitter(twitter))
    given = [[*_POST_COLUMNS, "lang"] if "lang" in p.columns else _POST_COLUMNS for p in parsed]
    searched = union_posts(*(p.select(*columns) for p, columns in zip(parsed, given)))
    known = with_language(searched, "text", load_model=load_language, by=language)
    english = filters.keep_english_lenient(known).select(*_POST_COLUMNS)
    cleaned = filters.clean_and_drop_empty(union_posts(reddit, english))
    return with_source_order(cleaned).withColumn("digest", text_digest(F.col("text")))


def _staged(df: DataFrame, stage_dir: str | None, name: str) -> DataFrame:
    """``df`` by way of a table under ``stage_dir``, or as it is without one."""
    if not stage_dir:
        return df
    path = f"{stage_dir}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def social_sentiment(
    comments: DataFrame,
    stocktwits: DataFrame,
    twitter: DataFrame,
    stocks: DataFrame,
    load_model: Callable[[], Model],
    *,
    null_user: str = "keep",
    stage_dir: str | None = None,
    model_tasks: int | None = None,
    model_tokens: int | None = None,
    profile: ResourceProfile | None = None,
    load_language: Callable[[], LanguageModel] | None = None,
    language: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The metrics row of every stock in ``stocks``.

    De-duplication does not read the score, so posts are scored after it, and
    each distinct text once. It works on digests; the texts are fetched again
    for the posts that are left. Both the prepared posts and those left are
    needed twice: with ``stage_dir``, a folder all executors can reach, they
    are written there once, which also ends their lineage; without it they
    are computed twice.
    """
    prepared = _staged(prepare_posts(comments, stocktwits, twitter, stocks, load_language, language), stage_dir, "prepared")
    kept = dedup_staged(prepared, null_user, "digest", with_text=False)
    kept = _staged(kept.select("stock", "source", "digest"), stage_dir, "kept")
    scored = score_by_digest(kept, prepared.select("digest", "text"), load_model, tasks=model_tasks, most_tokens=model_tokens, profile=profile)
    return stock_sentiment_metrics(scored, stocks)


def scored_posts_metrics(posts: DataFrame, *, null_user: str = "keep") -> DataFrame:
    """The metrics rows of posts that come with a ``probability``.

    The metrics do not ask for the texts, so only digests are shuffled.
    """
    return stock_sentiment_metrics(dedup_staged(posts, null_user, with_text=False))


def news_vs_return(
    news: DataFrame,
    prices: DataFrame,
    lexicon: DataFrame,
    start: Column,
    end: Column,
    *,
    minimum: int = MIN_HEADLINES,
    rules: Modifiers | None = None,
    language: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Daily returns beside the news sentiment of the session before.

    ``news``: ticker, id, ts, headline, and ``lang`` when it is known already.
    ``prices``: ticker, date, then value columns with the adjusted close fifth.
    With ``rules`` headlines are scored by these, else by the sum of their words'
    valences. ``language`` says the language of a column, such as a learned table.

    Tickers share headlines: language and score are found once for each distinct
    text, and only digests are de-duplicated per ticker.
    """
    marked = filters.drop_blank_news(news, "headline", "ts").withColumn("_digest", text_digest(F.col("headline")))
    kept = dedup_headlines(marked.drop("headline"), digest="_digest")
    # copies of a headline, also those of other tickers, are merged by hash before the shuffle
    texts = marked.select("_digest", "headline").distinct().withColumn("headline", clean_headline(F.col("headline")))
    vote = False
    if "lang" in news.columns and language is None:
        kept = filters.keep_english_strict(kept)
        texts = texts.join(kept.select("_digest").distinct(), "_digest", "left_semi")
    elif language:
        given = "lang" in news.columns
        texts = texts.withColumn("_found", language(F.col("headline")))
        found = texts.select("_digest", "_found")
        kept = kept.join(found, "_digest").withColumn("lang", F.coalesce("lang", "_found") if given else F.col("_found"))
        kept = filters.keep_english_strict(kept)
    else:
        vote = True
        # Both the vote and the score read the words. The generator, of one row a row, keeps Spark from
        # pushing the filter below it, where the words would be found a second time.
        texts = texts.select("*", F.explode_outer(F.array(words(F.col("headline")))).alias("_words"))
        texts = filters.keep_english_strict(texts.withColumn("lang", detect_language(F.col("headline"), F.col("_words"))))
    if rules:
        scores = rule_score(texts, lexicon, keys=["_digest"], rules=rules)
    else:
        scores = lexicon_score(texts, lexicon, keys=["_digest"], tokens="_words" if vote else None)
    scored = kept.select("ticker", "ts", "_digest").join(scores, "_digest")  # a digest has one row a ticker at most
    returns = sessions.daily_return(adjusted_close(prices, start, end))
    return sessions.with_session_before(returns, scored, score="compound", minimum=minimum)
