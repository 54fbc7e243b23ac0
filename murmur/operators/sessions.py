"""Trading sessions, headlines in them, and the returns that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from murmur.params import MIN_HEADLINES, SESSION_OPEN_HOUR, SESSION_OPEN_MINUTE


def _by_date() -> WindowSpec:
    """A ticker's days in order.

    (ticker, date) is the key of a price table, so a window holds one row per
    trading day at most: some 250 a year, however much data there is.
    """
    return Window.partitionBy("ticker").orderBy("date")


def daily_return(prices: DataFrame) -> DataFrame:
    """Price over previous price, less one; NULL in a ticker's first row."""
    previous = F.lag("adj_close").over(_by_date())
    return prices.withColumn("daily_return", F.try_divide("adj_close", previous) - 1)


def session_gap(prices: DataFrame) -> DataFrame:
    """Each session with the next one and the days between; the last is left out."""
    following = prices.select("ticker", "date", F.lead("date").over(_by_date()).alias("next_date"))
    return following.where(F.col("next_date").isNotNull()).withColumn("gap", F.datediff("next_date", "date"))


def session_day(ts: Column) -> Column:
    """The day whose 09:30 to 09:30 span holds ``ts``."""
    opening = F.make_dt_interval(F.lit(0), F.lit(SESSION_OPEN_HOUR), F.lit(SESSION_OPEN_MINUTE))
    return F.to_date(ts - opening)


def session_days(sessions: DataFrame) -> DataFrame:
    """One row per day a session spans: Friday's session is also Saturday's."""
    days = F.sequence("date", F.date_sub("next_date", 1), F.expr("interval 1 day"))
    return sessions.select("ticker", "date", "next_date", F.explode(days).alias("day"))


def headline_sessions(news: DataFrame, sessions: DataFrame, ts: str = "ts") -> DataFrame:
    """Every headline with its session.

    The published range test, 09:30 of a session to 09:30 of the next, is
    whole days once shifted, so the interval join is an equi-join on (ticker,
    day) that splits a busy ticker by day.
    """
    return news.withColumn("day", session_day(F.col(ts))).join(session_days(sessions), ["ticker", "day"]).drop("day")


def session_spans(sessions: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """Sessions with the times they open and close; each closes as the next one opens.

    ``openings`` has ``date`` and ``opens`` for days that don't open at 09:30,
    one row a day at most, such as after a delay or under another clock.
    """
    usual = lambda c: F.col(c).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(SESSION_OPEN_HOUR), F.lit(SESSION_OPEN_MINUTE)
    )
    if openings is None:
        return sessions.withColumns({"opens": usual("date"), "closes": usual("next_date")})
    at = openings.select(F.col("date").alias("_date"), F.col("opens").cast("timestamp_ntz").alias("_opens"))
    for name, day in (("opens", "date"), ("closes", "next_date")):
        sessions = sessions.join(at, F.col(day) == F.col("_date"), "left")
        sessions = sessions.withColumn(name, F.coalesce("_opens", usual(day))).drop("_date", "_opens")
    return sessions


def headlines_in_spans(news: DataFrame, spans: DataFrame, ts: str = "ts") -> DataFrame:
    """Every headline with the sessions of its ticker that are open at its time, ``opens`` included, ``closes`` not.

    For spans of any length at any time of day. A span is listed under every day
    it touches and a headline under its own, so they meet by an equi-join on
    (ticker, day), which splits a busy ticker by day, and the exact test is left
    for the pairs of a day. A headline meets a span once, as it has one day. A
    span that closes before it opens, or lacks a time, holds nothing.
    """
    # no earlier than the first day, as a sequence of spans that are left out may be looked at
    last = F.greatest(F.to_date("opens"), F.to_date(F.col("closes") - F.expr("interval 1 microsecond")))
    days = F.explode(F.sequence(F.to_date("opens"), last, F.expr("interval 1 day")))
    listed = spans.where(F.col("closes") > F.col("opens")).select("*", days.alias("_day"))
    at = F.col(ts)
    met = news.withColumn("_day", F.to_date(at)).join(listed, ["ticker", "_day"])
    return met.where((at >= F.col("opens")) & (at < F.col("closes"))).drop("_day")


def news_sessions(
    news: DataFrame, sessions: DataFrame, *, ts: str = "ts", score: str = "score", minimum: int = MIN_HEADLINES
) -> DataFrame:
    """Headlines and mean score per session, for sessions with enough headlines.

    News is summed by (ticker, day) before it meets the sessions, so the join
    sees one row per ticker and day, and a ticker or day that holds a third of
    all news is reduced on the map side.
    """
    daily = news.groupBy("ticker", session_day(F.col(ts)).alias("day")).agg(
        F.count(F.lit(1)).alias("_nb"), F.sum(score).alias("_sum"), F.count(score).alias("_scored")
    )
    return (
        session_days(sessions)
        .join(daily, ["ticker", "day"])
        .groupBy("ticker", "date", "next_date")
        .agg(
            F.sum("_nb").alias("nb"),
            F.try_divide(F.sum("_sum"), F.sum("_scored")).alias("sentiment"),
        )
        .where(F.col("nb") >= minimum)
    )


def sentiment_next_return(returns: DataFrame, scores: DataFrame) -> DataFrame:
    """Price rows with the sentiment of the session before; NULL without one."""
    before = scores.select("ticker", F.col("next_date").alias("date"), "sentiment")
    return returns.join(before, ["ticker", "date"], "left")


def with_session_before(
    returns: DataFrame, news: DataFrame, *, ts: str = "ts", score: str = "score", minimum: int = MIN_HEADLINES
) -> DataFrame:
    """Price rows with the mean score of the headlines since the session before opened; NULL for too few.

    What ``news_sessions`` and ``sentiment_next_return`` say together, in one pass
    over the prices: a row's session before begins on the date of the row before
    it. (ticker, date) is taken to be the key of the prices. A ticker's first row
    has no session before.
    """
    daily = news.groupBy("ticker", session_day(F.col(ts)).alias("day")).agg(
        F.count(F.lit(1)).alias("_nb"), F.sum(score).alias("_sum"), F.count(score).alias("_scored")
    )
    before = F.lag("date").over(_by_date())
    others = [c for c in returns.columns if c not in ("ticker", "date")]
    rows = returns.select("*", before.alias("_before"))
    days = F.sequence("_before", F.date_sub("date", 1), F.expr("interval 1 day"))
    rows = rows.select(*returns.columns, F.explode_outer(days).alias("day")).join(daily, ["ticker", "day"], "left")
    rows = rows.groupBy("ticker", "date").agg(
        *(F.first(c).alias(c) for c in others), F.sum("_nb").alias("_nb"), F.sum("_sum").alias("_sum"), F.sum("_scored").alias("_scored")
    )
    sentiment = F.when(F.col("_nb") >= minimum, F.try_divide("_sum", "_scored"))
    return rows.select(*returns.columns, sentiment.alias("sentiment"))
