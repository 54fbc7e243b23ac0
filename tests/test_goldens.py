"""Hand-made rows for each rule that the test tables do not reach."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from murmur.functions import labels, numbers
from murmur.functions import text as tx
from murmur.functions.language import UNUSUAL, with_language
from murmur.operators import calendar, dedup, filters, match, metrics, scoring, sessions, signals, universe
from murmur.params import SOURCES
from murmur.sources import holidays, html, posts, prices, sinks, trending
from murmur.sources import news as news_source


def one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression(F.col("x")).alias("y")).first()["y"]


def day(text):
    return dt.date.fromisoformat(text)


def at(text):
    return dt.datetime.fromisoformat(text)


# Text


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("x\n5 stars\ny", "x stars y"),
        ("a   b    c", "a  b  c"),
        ("go https://x.y/z?a=1,b now", "go ,b now"),
        ("https://x.y", " "),
        ("ABC $TSLA #Up @You", "abc $tsla #up @you"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_post(spark, raw, clean):
    assert one(spark, raw, tx.clean_post) == clean


@pytest.mark.parametrize("raw", ["\n", "\n5", "https://x.y", "  ", " ", "\r", "A"])
def test_only_an_empty_text_cleans_to_empty(spark, raw):
    assert one(spark, raw, tx.clean_post) != ""


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("go https://x.y/z rest\r\nnext", "go next"),
        ("up #TSLA by @you, now", "up TSLA by  now"),
        ("a  b", "a  b"),
        ("see http://a.b\n\n\nnext @x y", "see next  y"),
    ],
)
def test_clean_headline(spark, raw, clean):
    assert one(spark, raw, tx.clean_headline) == clean


@pytest.mark.parametrize(
    "text, hit",
    [
        ("FED", False),
        ("ED", True),
        ("_ED_", True),
        ("$ED", True),
        ("EDé", False),
        ("FED and ED", False),
        ("½ED", False),
        ("buy ED.", True),
        ("ed", False),
        ("", False),
    ],
)
def test_keyword_boundary(spark, theta_match, text, hit):
    df = spark.createDataFrame([(1, text)], "id INT, text STRING")
    stocks = spark.createDataFrame([("ED", ["ED"])], "stock STRING, keywords ARRAY<STRING>")
    assert match.keyword_match(df, stocks).count() == int(hit)
    assert theta_match(df, stocks, "id").count() == int(hit)


def test_keyword_any_occurrence(spark):
    df = spark.createDataFrame(
        [(1, "FED and ED"), (2, "BRK.BX but BRK.B"), (3, "BRK.BX"), (4, "a++b and ++")], "id INT, text STRING"
    )
    stocks = spark.createDataFrame(
        [("ED", ["ED"]), ("BRK", ["BRK.B"]), ("PLUS", ["++"])], "stock STRING, keywords ARRAY<STRING>"
    )
    found = match.keyword_match(df, stocks, all_occurrences=True).select("id", "stock")
    assert {tuple(r) for r in found.collect()} == {(1, "ED"), (2, "BRK"), (4, "PLUS")}
    first = match.keyword_match(df, stocks).select("id", "stock")
    assert first.count() == 0


def test_keyword_of_many_lists_counts_once(spark):
    df = spark.createDataFrame([(1, "Tesla TSLA $TSLA"), (2, "only TSLA")], "id INT, text STRING")
    stocks = spark.createDataFrame([("TSLA", ["Tesla", "TSLA", "$TSLA"])], "stock STRING, keywords ARRAY<STRING>")
    found = match.keyword_match(df, stocks).select("id", "keyword")
    assert {tuple(r) for r in found.collect()} == {(1, "Tesla"), (2, "TSLA")}


def test_empty_and_missing_keywords_match_nothing(spark):
    df = spark.createDataFrame([(1, "$ A"), (2, None), (3, "")], "id INT, text STRING")
    lists = [("A", ["", None, "A"]), ("NONE", [""]), ("EMPTY", []), ("NULL", None)]
    stocks = spark.createDataFrame(lists, "stock STRING, keywords ARRAY<STRING>")
    found = match.keyword_match(df, stocks).select("id", "stock", "keyword")
    assert [tuple(r) for r in found.collect()] == [(1, "A", "A")]
    nothing = match.keyword_match(df, stocks.where("stock = 'EMPTY'"))
    assert nothing.count() == 0


def test_long_keyword_lists_use_the_lambda_form(spark):
    words = [f"k{i}" for i in range(15)]
    df = spark.createDataFrame([(1, "k14 k3 k9"), (2, "k12"), (3, "k")], "id INT, text STRING")
    stocks = spark.createDataFrame([("S", words)], "stock STRING, keywords ARRAY<STRING>")
    found = match.keyword_match(df, stocks).select("id", "keyword")
    assert {tuple(r) for r in found.collect()} == {(1, "k3"), (2, "k12")}


def test_parse_twitter(spark):
    df = spark.createDataFrame(
        [(1, "bob\n@bob\n·\n2h\nline one\nline two"), (2, "amy\n@amy"), (3, "zed")], "id INT, raw STRING"
    )
    got = {r["id"]: (r["user"], r["text"]) for r in posts.parse_twitter(df).collect()}
    assert got == {1: ("bob", "line one line two"), 2: ("amy", ""), 3: ("zed", "")}


def test_parse_stocktwits(spark):
    df = spark.createDataFrame(
        [
            (1, "bob\nBullish\n10:05 AM\nto the\nmoon"),
            (2, "amy\n10:05 AM\nflat\ntoday"),
            (3, "zed\nvery Bearish now\n10:05 AM\ndown"),
            (4, "too\nBullish\nshort"),
            (5, "alone"),
        ],
        "id INT, raw STRING",
    )
    got = {r["id"]: (r["user"], r["directional"], r["text"]) for r in posts.parse_stocktwits(df).collect()}
    assert got == {
        1: ("bob", "Bullish", "to the\nmoon"),
        2: ("amy", "", "flat\ntoday"),
        3: ("zed", "very Bearish now", "down"),
        4: ("too", "Bullish", None),
        5: ("alone", "", None),
    }


@pytest.mark.parametrize(
    "title, name",
    [
        ("Apple Inc.", "Apple"),
        ("Alphabet Corp. Class A", "Alphabet Class"),
        ("Foo, Bar Corporation", "Foo Bar"),
        ("Unlimited  Ltd", "Un"),
        ("A B", ""),
    ],
)
def test_company_name(spark, title, name):
    assert one(spark, title, tx.company_name) == name


def test_normalize_company(spark):
    df = spark.createDataFrame([(" brk.b ", "Berkshire Co.")], "symbol STRING, title STRING")
    row = universe.normalize_company(df).first()
    assert (row["symbol"], row["name"], row["keyword"]) == ("brk.b", "Berkshire", "BRK.B")


# Numbers


@pytest.mark.parametrize(
    "text, cap",
    [("1.2T", 1.2e12), ("3B", 3e9), ("4.5M", 4.5e6), ("N/A", None), ("12k", None), ("", None), (None, None), ("B", None)],
)
def test_market_cap(spark, text, cap):
    got = one(spark, text, numbers.market_cap)
    assert got == cap or math.isclose(got, cap)


def test_net_sentiment(spark):
    e = math.e
    assert math.isclose(
        one(spark, [-1.0, 0.0, 1.0], numbers.net_sentiment, "array<float>"), (e - 1 / e) / (e + 1 + 1 / e)
    )
    assert one(spark, [1000.0, 0.0, -1000.0], numbers.net_sentiment, "array<float>") == -1.0
    assert one(spark, [0.0, 50.0], numbers.net_sentiment, "array<float>") is None


# Labels


def test_age_labels(spark):
    df = spark.createDataFrame([(h,) for h in (1, 2, 23, 24, 0)], "h INT")
    now = F.lit("2021-11-30 10:00:00").cast("timestamp_ntz")
    got = [r[0] for r in df.select(labels.age_label(now, F.col("h"))).collect()]
    assert got == ["1 hour ago", "2 hours ago", "23 hours ago", "Nov 29", "Nov 30"]


def test_post_time_labels(spark):
    now = F.lit("2024-01-06 23:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame(
        [(at("2024-01-06 00:07:00"),), (at("2024-01-06 13:07:00"),), (at("2024-01-05 13:07:00"),)], "x timestamp_ntz"
    )
    got = [r[0] for r in df.select(labels.post_time_label(F.col("x"), now)).collect()]
    assert got == ["12:07 AM", "01:07 PM", "1/5/24"]


def test_age_label_spine(spark):
    short = one(spark, 6, labels.age_label_hours, "int")
    assert len(short) == 59
    assert short[:18] == list(range(6, 24))
    assert short[18:21] == [23, 47, 71]
    long = one(spark, 168, labels.age_label_hours, "int")
    assert long[:3] == [168, 192, 216] and len(long) == 59


def test_post_time_spine(spark):
    def spine(now, hours):
        df = spark.createDataFrame([(at(now), hours)], "now timestamp_ntz, h int")
        return df.select(labels.post_time_spine(F.col("now"), F.col("h"))).first()[0]

    today = spine("2024-01-06 10:30:00", 6)
    assert len(today) == 4 * 60 + 31
    assert today[0] == at("2024-01-06 04:30:00") and today[-1] == at("2024-01-06 00:00:00")
    earlier = spine("2024-01-06 03:00:00", 6)
    assert len(earlier) == 40
    assert earlier[1] == at("2024-01-04 21:00:00")


def test_day_spine(spark):
    df = spark.createDataFrame([(day("2024-02-28"), day("2024-03-01"))], "a date, b date")
    row = df.select(
        labels.days_apart(F.col("b"), F.col("a")).alias("n"), labels.day_spine(F.col("a"), F.col("b")).alias("days")
    ).first()
    assert row["n"] == 2
    assert row["days"] == [day("2024-02-28"), day("2024-02-29"), day("2024-03-01")]


def test_lookback_hours(spark):
    calendar_ = spark.createDataFrame([(day("2024-01-01"),), (day("2024-07-03"),)], "date date")
    days = spark.createDataFrame(
        [(day("2024-01-02"),), (day("2024-07-04"),), (day("2024-01-08"),), (day("2024-01-10"),)], "date date"
    )
    got = {r["date"].isoformat(): r["hours"] for r in calendar.lookback_hours(days, calendar_).collect()}
    # a Tuesday after a holiday, a Thursday after one, a Monday, a plain Wednesday
    assert got == {"2024-01-02": 48, "2024-07-04": 24, "2024-01-08": 48, "2024-01-10": 0}


def test_holiday_cells(spark):
    df = spark.createDataFrame(
        [("New Year", "Friday, January 1", "—*"), ("Late", "Monday,   July 5 (observed)", "Monday, July 4**")],
        "holiday STRING, `2021` STRING, `2022` STRING",
    )
    got = {(r["holiday"], r["date"].isoformat()) for r in holidays.holidays_long(df).collect()}
    assert got == {("New Year", "2021-01-01"), ("Late", "2021-07-05"), ("Late", "2022-07-04")}


# De-duplication

POSTS = "stock STRING, source STRING, user STRING, text STRING, seq BIGINT"


def arrivals(spark, rows):
    return dedup.with_source_order(spark.createDataFrame(rows, POSTS))


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_staged_dedup_differs_from_single_pass(spark):
    df = arrivals(
        spark,
        [
            ("S", "reddit", None, "r", 0),
            ("S", "stocktwit", "u1", "x", 1),
            ("S", "stocktwit", "u1", "y", 2),
            ("S", "twitter", "u2", "y", 3),
        ],
    )
    assert seqs(dedup.dedup_staged(df)) == [0, 1, 3]
    assert seqs(dedup.dedup_single_pass(df)) == [0, 1]


def test_null_users(spark):
    df = arrivals(
        spark,
        [
            ("S", "reddit", None, "a", 0),
            ("S", "reddit", None, "b", 1),
            ("S", "stocktwit", "x", "c", 2),
            ("S", "stocktwit", None, "d", 3),
            ("T", "reddit", None, "a", 4),
        ],
    )
    assert seqs(dedup.dedup_user(df, "keep")) == [0, 1, 2, 3, 4]
    assert seqs(dedup.dedup_user(df, "collapse")) == [0, 2, 4]
    with pytest.raises(ValueError):
        dedup.dedup_user(df, "other")


def test_same_user_on_two_sources_is_one(spark):
    df = arrivals(spark, [("S", "twitter", "u", "a", 0), ("S", "stocktwit", "u", "b", 1)])
    assert seqs(dedup.dedup_staged(df)) == [1]


# News


def test_news_blanks_and_order(spark):
    df = spark.createDataFrame(
        [
            (1, "T", None, 1),
            (2, "T", "  ", 1),
            (3, "T", "a #b", None),
            (5, "T", "a #b", 9),
            (4, "T", "a #b", 8),
            (6, "T", "a b", 7),
            (7, "U", "a b", 7),
        ],
        "id BIGINT, ticker STRING, headline STRING, datetime BIGINT",
    )
    got = [(r["id"], r["headline"]) for r in filters.clean_news(df).orderBy("id").collect()]
    # equal only after cleaning: both stay
    assert got == [(4, "a b"), (6, "a b"), (7, "a b")]


def test_drop_foreign_by_value(spark):
    df = spark.createDataFrame(
        [(1, "T", "a", "en"), (2, "T", "a", "fr"), (3, "T", "b", "en"), (4, "U", "a", "en"), (5, "T", "c", None)],
        "id BIGINT, ticker STRING, headline STRING, lang STRING",
    )
    assert sorted(r["id"] for r in filters.drop_foreign_headlines(df).collect()) == [3, 4]


def test_news_json_needs_every_key(spark, tmp_path):
    folder = tmp_path / "landing" / "ticker=T"
    folder.mkdir(parents=True)
    full = '{"category":"c","datetime":1,"headline":"h","id":%d,"image":"","related":"T","source":"s","summary":%s,"url":"u"}'
    lines = [full % (1, '"x"'), full % (2, "null"), '{"category":"c","id":3}', "not json"]
    (folder / "day.json").write_text("\n".join(lines))
    got = news_source.read_news_json(spark, str(tmp_path / "landing"))
    assert sorted(r["id"] for r in got.collect()) == [1, 2]
    target = str(tmp_path / "news")
    news_source.write_news(got, target)
    news_source.write_news(got.where("id = 1"), target)
    assert [r["id"] for r in news_source.read_news(spark, target).collect()] == [1]
    other = got.where("id = 2").withColumn("ticker", F.lit("U"))
    news_source.write_news(other, target)
    assert sorted(r["id"] for r in news_source.read_news(spark, target).collect()) == [1, 2]


def test_sessions_span_the_weekend(spark):
    price = spark.createDataFrame(
        [("T", day("2024-01-05"), 10.0), ("T", day("2024-01-08"), 12.0), ("T", day("2024-01-09"), 9.0)],
        "ticker STRING, date DATE, adj_close DOUBLE",
    )
    news = spark.createDataFrame(
        [
            ("T", at("2024-01-05 09:29:59"), 9.0),
            ("T", at("2024-01-05 09:30:00"), 0.1),
            ("T", at("2024-01-07 12:00:00"), 0.3),
            ("T", at("2024-01-08 09:29:59"), 0.5),
            ("T", at("2024-01-08 09:30:00"), -1.0),
            ("T", at("2024-01-09 09:30:00"), 9.0),
            ("U", at("2024-01-06 09:30:00"), 9.0),
        ],
        "ticker STRING, ts TIMESTAMP_NTZ, score DOUBLE",
    )
    gaps = sessions.session_gap(price)
    assert [(r["date"].day, r["gap"]) for r in gaps.orderBy("date").collect()] == [(5, 3), (8, 1)]
    scores = sessions.news_sessions(news, gaps, minimum=1)
    got = {r["date"].day: (r["nb"], round(r["sentiment"], 9)) for r in scores.collect()}
    assert got == {5: (3, 0.3), 8: (1, -1.0)}
    few = sessions.news_sessions(news, gaps, minimum=2)
    rows = sessions.sentiment_next_return(sessions.daily_return(price), few).orderBy("date").collect()
    assert [r["sentiment"] and round(r["sentiment"], 9) for r in rows] == [None, 0.3, None]
    assert [r["daily_return"] and round(r["daily_return"], 9) for r in rows] == [None, 0.2, -0.25]
    none = sessions.news_sessions(news, gaps, minimum=99)
    assert sessions.sentiment_next_return(price, none).where("sentiment is not null").count() == 0


def test_return_after_a_zero_price(spark):
    price = spark.createDataFrame(
        [("T", day("2024-01-05"), 0.0), ("T", day("2024-01-08"), 12.0)], "ticker STRING, date DATE, adj_close DOUBLE"
    )
    assert [r["daily_return"] for r in sessions.daily_return(price).collect()] == [None, None]


def test_adjusted_close(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text(
        "ticker,date,open,high,low,close,adj_close,volume,dividend,split\n"
        "T,2024-01-05,1,2,3,4,5,6,0,1\nT,2024-01-08,1,2,3,4,,6,0,1\nT,2024-01-10,1,2,3,4,7,6,0,1\nT,2024-01-11,1,2,3,4,8,6,0,1\n"
    )
    got = prices.adjusted_close(
        prices.read_prices(spark, str(path)), F.lit("2024-01-05").cast("date"), F.lit("2024-01-10").cast("date")
    )
    assert [(r["date"].day, r["adj_close"]) for r in got.orderBy("date").collect()] == [(5, 5.0), (10, 7.0)]


# Metrics and signals

SCORED = "stock STRING, source STRING, user STRING, text STRING, directional STRING, probability DOUBLE, seq BIGINT"


def test_metrics_of_a_stock_with_one_source(spark):
    df = spark.createDataFrame([("S", "twitter", "u", "t", None, 0.5, 1)], SCORED)
    stocks = spark.createDataFrame([("S",), ("NONE",)], "stock STRING")
    got = {r["stock"]: r.asDict() for r in metrics.stock_sentiment_metrics(df, stocks).collect()}
    assert got["S"]["nb_reddit"] == 0 and got["S"]["avg_reddit"] is None
    assert got["S"]["total_nb"] == got["S"]["nb_twitter"] == 1 and got["S"]["total_avg"] == 0.5
    assert got["S"]["accuracy"] is None
    assert got["NONE"]["total_nb"] == 0 and got["NONE"]["total_avg"] is None
    assert {(r["source"], r["nb"]) for r in metrics.nb_comments(df).collect()} == {
        ("reddit", 0),
        ("stocktwit", 0),
        ("twitter", 1),
    }


def test_total_mean_is_over_posts(spark):
    rows = [("S", "reddit", None, "a", None, 1.0, 1), ("S", "twitter", "u", "b", None, 0.0, 2)]
    rows.append(("S", "twitter", "v", "c", None, 0.0, 3))
    row = metrics.stock_sentiment_metrics(spark.createDataFrame(rows, SCORED)).first()
    assert math.isclose(row["total_avg"], 1 / 3)


def test_directional_accuracy(spark):
    rows = [
        ("S", "stocktwit", "a", "a", "Bullish", 0.2, 1),
        ("S", "stocktwit", "b", "b", "Bearish", 0.2, 2),
        ("S", "stocktwit", "c", "c", "", 0.2, 3),
        ("S", "stocktwit", "d", "d", "Bearish", 0.0, 4),
        ("S", "twitter", "e", "e", "Bullish", 0.2, 5),
    ]
    row = metrics.directional_accuracy(spark.createDataFrame(rows, SCORED)).first()
    assert row["nb_tagged"] == 3 and math.isclose(row["accuracy"], 1 / 3)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(11)] + [(None,)], "x DOUBLE")
    got = metrics.sentiment_histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 2, 2, 2, 3]
    same = metrics.sentiment_histogram(spark.createDataFrame([(2.0,), (2.0,)], "x DOUBLE"), "x", 50)
    assert {r["bin"]: r["n"] for r in same.collect() if r["n"]} == {25: 2}
    assert metrics.sentiment_histogram(df.where("x is null"), "x").count() == 0


def test_position_signal(spark):
    rows = [
        ("long", 61, 0.21),
        ("short", 61, -0.21),
        ("few", 60, 0.9),
        ("hold", 5, 0.16),
        ("drop", 100, 0.15),
        ("flip", 100, -0.9),
        ("cover", 100, -0.15),
        ("bear", 5, -0.16),
        ("flat", 100, 0.2),
    ]
    table = spark.createDataFrame(rows, "stock STRING, total_nb BIGINT, total_avg DOUBLE")
    held = spark.createDataFrame(
        [("hold", "long"), ("drop", "long"), ("flip", "long"), ("cover", "short"), ("bear", "short"), ("gone", "long")],
        "stock STRING, held STRING",
    )
    got = {r["stock"]: r["signal"] for r in signals.position_signal(table, held).collect()}
    assert got == {
        "long": "long",
        "short": "short",
        "few": "none",
        "hold": "long",
        "drop": "exit",
        "flip": "exit",
        "cover": "exit",
        "bear": "short",
        "flat": "none",
        "gone": "exit",
    }


def test_metrics_file(spark, tmp_path):
    df = spark.createDataFrame([("S", "twitter", "u", "t", None, 0.1 + 0.2, 1)], SCORED)
    wide = metrics.stock_sentiment_metrics(df)
    path = str(tmp_path / "metrics")
    sinks.write_metrics_csv(wide, path)
    header = spark.read.text(path).first()[0]
    assert header.startswith("stock,Total average sentiment,Total number of comments,Stocktwits sentiment accuracy")
    back = sinks.read_metrics_csv(spark, path).first().asDict()
    assert back == {**wide.first().asDict()}


# Universe


def test_take_until_repeat(spark):
    rows = spark.createDataFrame(list(enumerate("ABCBDA")), "pos INT, ticker STRING")
    assert sorted(r["ticker"] for r in universe.take_until_repeat(rows).collect()) == ["A", "B", "C"]
    once = spark.createDataFrame(list(enumerate("ABC")), "pos INT, ticker STRING")
    assert universe.take_until_repeat(once).count() == 3


def test_universe_merge(spark):
    schema = "pos INT, symbol STRING, name STRING, keyword STRING"
    busy = spark.createDataFrame([(0, "A", "first", "A"), (1, "A", "second", "A"), (2, "B", "b", "B")], schema)
    shorted = spark.createDataFrame([(0, "B", "other b", "B2"), (1, "C", "c", "C")], schema)
    got = {
        r["symbol"]: (r["is_trending"], r["name"], r["keywords"])
        for r in universe.universe_merge((busy, True), (shorted, False)).collect()
    }
    assert got == {"A": (True, "first", ["A"]), "B": (True, "other b", ["B2"]), "C": (False, "c", ["C"])}


def test_short_levels(spark):
    df = spark.createDataFrame([("A", 30), ("B", 29)], "symbol STRING, short_pct INT")
    assert [r["symbol"] for r in filters.keep_shorted(df).collect()] == ["A"]
    with pytest.raises(ValueError):
        filters.keep_shorted(df, level=7)


def test_trending_repeats_count(spark):
    body = '{"symbols":[' + ",".join('{"symbol":"A","title":"t","x":1}' for _ in range(12)) + "]}"
    df = spark.createDataFrame([(1, body)], "id INT, body STRING")
    assert trending.take_trending(trending.flatten_trending(df, F.col("body"))).count() == 10


def test_lookback_by_source(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    rows = [
        ("T", "reddit", at("2024-01-09 19:00:00"), 1),
        ("T", "twitter", at("2024-01-09 19:00:00"), 2),
        ("T", "twitter", at("2024-01-08 19:00:00"), 3),
        ("O", "reddit", at("2024-01-08 19:00:00"), 4),
        ("O", "twitter", at("2024-01-08 19:00:00"), 5),
        ("O", "twitter", at("2024-01-10 00:00:00"), 6),
    ]
    df = spark.createDataFrame(rows, "stock STRING, source STRING, ts TIMESTAMP_NTZ, seq BIGINT")
    flags = spark.createDataFrame([("T", True)], "stock STRING, is_trending BOOLEAN")
    hours = universe.with_lookback(df.select("stock").distinct(), flags)
    assert seqs(universe.posts_in_lookback(df, hours, now)) == [1, 2, 5]


# Pages


def test_html_rows(spark):
    page = (
        '<table><tr valign="top"><td>No.</td><th>Ticker</th></tr>\n'
        "<TR><td>1</td><td><a href='x'>A&amp;B</a></td><td>Co</td></TR></table><table><tr><td>z</td></tr></table>"
    )
    df = spark.createDataFrame([(1, page)], "id INT, html STRING")
    rows = html.html_rows(df, F.col("html")).orderBy("row_no").collect()
    assert [r["cells"] for r in rows] == [["No.", "Ticker"], ["1", "A&B", "Co"], ["z"]]
    top = html.html_rows(df, F.col("html"), html.row_with("valign", "top")).collect()
    assert [r["cells"] for r in top] == [["No.", "Ticker"]]
    lenient = html.html_rows_lenient(df, "id", "html").orderBy("row_no").collect()
    assert [r["cells"] for r in lenient][:2] == [["No.", "Ticker"], ["1", "A&B", "Co"]]


def test_both_screen_readers_take_the_same_rows(spark):
    page = (
        "<table><tr><td>1</td><td>NEWS</td><td>x</td></tr></table><table><TR class=a VALIGN='top'><td>No.</td><td>Ticker</td><td>Company</td></TR>"
        '<tr valign = "top"><td>1</td><td>GME</td><td>Game\nStop\n</td></tr><tr valign="topmost"><td>9</td><td>NO</td><td>n</td></tr>'
        "</table><table><tr valign=top><td>2</td><td>AMC</td><td>A&amp;C</td></tr><tr><td>Next</td></tr></table>"
    )
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page INT, html STRING")
    expected = [(1, 1, "GME", "Game\nStop"), (1, 2, "AMC", "A&C")]
    for closed in (True, False):
        assert sorted(map(tuple, html.screener_rows(df, "page", closed=closed).collect())) == expected


def test_cap_of_a_page(spark):
    page = "<table><tr><td>a</td><td>b</td></tr></table><table class='W Bdcl'><tr><th>Cap</th><td><i>1.2T</i></td></tr><tr><td>x</td><td>y</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, None)], "id INT, html STRING")
    assert [r["cap"] for r in html.first_cell_after_label(df, F.col("html"), "cap", "Bdcl").collect()] == ["1.2T", None]
    assert html.first_cell_after_label(df, F.col("html"), "cap").first()["cap"] == "b"


def test_html_rows_lenient(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>a<td>b<tr><td>c"), (2, None)], "id INT, html STRING")
    rows = html.html_rows_lenient(df, "id", "html").orderBy("row_no").collect()
    assert [(r["id"], r["cells"]) for r in rows] == [(1, ["a", "b"]), (1, ["c"])]


# Sources and scoring


def test_posts_in_window(spark):
    now = F.lit("2024-01-10 12:00:00.9").cast("timestamp_ntz")
    rows = [
        (1, at("2024-01-10 06:00:00"), "a"),
        (2, at("2024-01-10 05:59:59"), "a"),
        (3, at("2024-01-10 12:00:00"), "a"),
        (4, at("2024-01-10 11:00:00"), "[removed]"),
        (5, at("2024-01-10 11:59:59"), ""),
    ]
    df = spark.createDataFrame(rows, "seq BIGINT, ts TIMESTAMP_NTZ, body STRING")
    assert seqs(posts.posts_in_window(df, now, 6)) == [1, 5]


def test_cap_posts(spark):
    rows = [(i, at("2024-01-10 06:00:00") + dt.timedelta(seconds=(i * 7) % 300), "a") for i in range(400)]
    df = spark.createDataFrame(rows, "seq BIGINT, ts TIMESTAMP_NTZ, body STRING")
    for limit in (1, 57, 399, 400, 1000):
        expected = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))[:limit]]
        assert seqs(posts.cap_posts(df, limit=limit)) == sorted(expected)


def test_cap_posts_odd_rows(spark):
    """No time, no number, rows alike at the cap, and no rows."""
    second = at("2024-01-10 06:00:00")
    rows = [(None, None, "a"), (3, None, "b"), (None, second, "c"), *[(5, second, "d")] * 4, (9, second + dt.timedelta(microseconds=7), "e")]
    df = spark.createDataFrame(rows, "seq BIGINT, ts TIMESTAMP_NTZ, body STRING")
    for limit in range(0, 10):
        assert sorted(r["body"] for r in posts.cap_posts(df, limit=limit).collect()) == sorted(r[2] for r in rows[:limit])
        assert sorted(map(str, posts.cap_posts(df.select("ts", "seq"), limit=limit).collect())) == sorted(
            map(str, df.select("ts", "seq").limit(limit).collect())
        )


def test_cap_posts_gets_the_posts_at_most_twice(spark):
    rows = [(i, at("2024-01-10 06:00:00") + dt.timedelta(seconds=(i * 7) % 300), "a") for i in range(400)]
    df = spark.createDataFrame(rows, "seq BIGINT, ts TIMESTAMP_NTZ, body STRING")
    got = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            got.add(batch.num_rows)
            yield batch

    counted = df.mapInArrow(count, df.schema)
    assert posts.cap_posts(counted, limit=57).count() == 57 and got.value <= 2 * len(rows)
    got.value = 0
    assert posts.cap_posts(counted.select("seq", "ts"), limit=57).count() == 57 and got.value <= len(rows)


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("S", "reddit")], "stock STRING, source STRING")
    b = spark.createDataFrame([("S", "twitter", "u")], "stock STRING, source STRING, user STRING")
    assert {(r["source"], r["user"]) for r in posts.union_posts(a, b).collect()} == {("reddit", None), ("twitter", "u")}


def test_lenient_language(spark):
    df = spark.createDataFrame(
        [("reddit", "fr", "x"), ("twitter", "pl", "x"), ("twitter", "fr", "x"), ("twitter", "en", ""), ("twitter", None, "x")],
        "source STRING, lang STRING, text STRING",
    )
    assert filters.keep_english_lenient(df).count() == 1
    assert filters.keep_english_lenient(df, exempt=("reddit",)).count() == 2


def test_unusual_characters_are_named_by_range(spark):
    """The ranges hold what a slow class of all but the usual characters does."""
    edges = [0, 0xB4, 0xB5, 0xB6, 0x24F, 0x250, 0x1FFF, 0x2000, 0x206F, 0x2070, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF]
    df = spark.createDataFrame([(n, f"a{chr(n)}b") for n in edges], "n INT, text STRING")
    found = {r["n"] for r in df.where(F.rlike("text", F.lit(UNUSUAL))).collect()}
    assert found == {n for n in edges if not (n <= 0xB4 or 0xB6 <= n <= 0x24F or 0x2000 <= n <= 0x206F)}


def test_language_by_stopwords(spark):
    rows = [
        ("The cat is on the mat with a hat", "en"),
        ("Le chat est dans la maison et les arbres", "fr"),
        ("Der Hund und die Katze sind nicht auf dem Tisch", "de"),
        ("El perro y los gatos por la noche", "es"),
        ("Apple beats Q3 estimates", "en"),
        ("Tesla shares jump 5%", "en"),
        ("$GME $TSLA AMC", "en"),
        ("Акции Tesla сегодня выросли", "xx"),
        ("テスラ の 株価 $TSLA", "xx"),
        ("Il titolo non sale come una volta, gli analisti sono divisi", "it"),
        ("De koers van het aandeel is niet gestegen", "nl"),
        ("Kurs akcji spada dziś bardzo mocno wśród wszystkich dużych banków", None),
        ("123 !", None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "text STRING, expected STRING")
    assert [(r["text"], r["lang"]) for r in with_language(df, "text").collect()] == rows


def test_language_given_or_by_model(spark):
    rows = [("Le chat est dans la maison", "en"), ("Le chat est dans la maison", None)]
    df = spark.createDataFrame(rows, "text STRING, lang STRING")
    assert [r["lang"] for r in with_language(df, "text").collect()] == ["en", "fr"]
    load = lambda: lambda texts: [f"m{len(t)}" for t in texts]
    assert [r["lang"] for r in with_language(df, "text", load_model=load).collect()] == ["en", "m26"]


def test_foreign_headlines_go_by_value(spark):
    rows = [(1, "T", "a", "en"), (2, "T", "a", "fr"), (3, "T", "b", "en"), (4, "U", "a", "en"), (5, "T", "c", None)]
    df = spark.createDataFrame(rows, "id INT, ticker STRING, headline STRING, lang STRING")
    assert sorted(r["id"] for r in filters.drop_foreign_headlines(df).collect()) == [3, 4]


def test_lexicon_score(spark):
    df = spark.createDataFrame([(1, "Good good day"), (2, "bad"), (3, "nothing"), (4, "")], "id INT, headline STRING")
    words = spark.createDataFrame([("good", 2.0), ("bad", -1.5)], "token STRING, valence DOUBLE")
    got = {r["id"]: r["compound"] for r in scoring.lexicon_score(df, words, keys=["id"]).collect()}
    assert math.isclose(got[1], 4 / math.sqrt(16 + 15))
    assert math.isclose(got[2], -1.5 / math.sqrt(2.25 + 15))
    assert got[3] == got[4] == 0.0


def test_each_text_is_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            calls.add(len(texts))
            return [[0.0, 0.0, float(len(t))] for t in texts]

        return model

    rows = [("S", s, "same" if i % 3 else f"t{i}", i) for i, s in enumerate(SOURCES * 10)]
    df = spark.createDataFrame(rows, "stock STRING, source STRING, text STRING, seq BIGINT")
    scored = scoring.score_posts_batch(df, load).collect()
    assert len(scored) == len(rows)
    assert calls.value == len({r[2] for r in rows})
    assert all(-1 <= r["probability"] <= 1 for r in scored)
