"""What must hold for any input, checked against brute force or by symmetry."""

import random

import pytest
from pyspark.sql import functions as F

from murmur.operators import dedup, match, metrics, sessions
from murmur.params import SOURCES
from murmur.plans import jobs
from murmur.plans import views as v

POSTS = "stock STRING, source STRING, user STRING, text STRING, seq BIGINT"


def random_posts(seed, rows=400, hot=0.0):
    """Posts in random order; ``hot`` of them share one text and one user."""
    rng = random.Random(seed)
    out = []
    for seq in range(rows):
        source = rng.choice(SOURCES)
        stock, text, user = rng.choice("ST"), f"t{rng.randrange(40)}", f"u{rng.randrange(25)}"
        if rng.random() < hot:
            stock, text, user = "S", "hot", "u0"
        if source == "reddit" or rng.random() < 0.05:
            user = None
        out.append((stock, source, user, text, seq))
    rng.shuffle(out)
    return out


def first_of(rows, key):
    seen, kept = set(), []
    for row in rows:
        if key(row) not in seen:
            seen.add(key(row))
            kept.append(row)
    return kept


def staged(rows, null_user):
    """The fold as it is defined: append a source, drop texts, drop users."""

    def user_key(row):
        return (row[2], row[4]) if row[2] is None and null_user == "keep" else row[2]

    result = []
    for stock in {row[0] for row in rows}:
        kept = []
        for number, source in enumerate(SOURCES):
            kept += sorted((r for r in rows if r[0] == stock and r[1] == source), key=lambda r: r[4])
            kept = first_of(kept, lambda r: r[3])
            if number:
                kept = first_of(kept, user_key)
        result += kept
    return sorted(row[4] for row in result)


@pytest.mark.parametrize("null_user", ["keep", "collapse"])
@pytest.mark.parametrize("seed, hot", [(1, 0.0), (2, 0.0), (3, 0.4)])
def test_staged_dedup_is_the_fold(spark, seed, hot, null_user):
    rows = random_posts(seed, hot=hot)
    df = dedup.with_source_order(spark.createDataFrame(rows, POSTS)).repartition(7)
    got = dedup.dedup_staged(df, null_user=null_user)
    assert sorted(r["seq"] for r in got.collect()) == staged(rows, null_user)
    again = dedup.dedup_staged(got, null_user=null_user)
    assert sorted(r["seq"] for r in again.collect()) == staged(rows, null_user)


def brute_match(text, keyword):
    at = text.find(keyword)
    if at < 0:
        return False
    left, right = text[at - 1 : at] if at else "", text[at + len(keyword) : at + len(keyword) + 1]
    return not left.isalnum() and not right.isalnum()


@pytest.mark.parametrize("max_broadcast_rows", [1000, 0])
def test_keyword_match_is_the_loop(spark, theta_match, max_broadcast_rows):
    rng = random.Random(5)
    pieces = ["ED", "FED", " ", "$", ".", "_", "é", "BRK.B", "BRK", "½", "x", "  ", "++", "\n", "A", "AA"]
    texts = [(i, "".join(rng.choices(pieces, k=rng.randrange(9)))) for i in range(600)]
    stocks = {
        "ED": ["ED"],
        "BRK": ["BRK.B", "BRK"],
        "A": ["A", "AA", "$A"],
        "PLUS": ["++", "$"],
        "NONE": ["nowhere"],
        "MANY": ["FED", "ED", "x"],
    }
    expected = set()
    for number, text in texts:
        for stock, keywords in stocks.items():
            found = [k for k in keywords if brute_match(text, k)]
            if found:
                expected.add((number, stock, found[0]))
    df = spark.createDataFrame(texts, "id INT, text STRING").repartition(5)
    universe = spark.createDataFrame(list(stocks.items()), "stock STRING, keywords ARRAY<STRING>")
    got = match.keyword_match(df, universe, max_broadcast_rows=max_broadcast_rows)
    rows = [tuple(r) for r in got.select("id", "stock", "keyword").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert {tuple(r) for r in theta_match(df, universe, "id").collect()} == expected


@pytest.mark.parametrize("max_broadcast_rows", [1000, 0])
def test_every_post_matches_for_itself(spark, max_broadcast_rows):
    """Ids that repeat or are missing change nothing, in either form of the join."""
    rows = [(1, "GME up"), (None, "GME up"), (2, "GME down"), (2, "GME down"), (2, "no"), (3, None), (None, "")]
    posts = spark.createDataFrame(rows, "id INT, text STRING")
    universe = spark.createDataFrame([("GME", ["GME", "up"]), ("X", ["down"])], "stock STRING, keywords ARRAY<STRING>")
    got = match.keyword_match(posts, universe, max_broadcast_rows=max_broadcast_rows).collect()
    expected = [(i, t, "GME", "GME") for i, t in rows[:4]] + [(2, "GME down", "X", "down")] * 2
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_longer_lookbacks_keep_their_posts(spark):
    from murmur.operators.universe import posts_in_lookback, with_lookback

    stocks = spark.createDataFrame([("A", False), ("B", True)], "stock STRING, is_trending BOOLEAN")
    posts = spark.sql("""select stock, 'twitter' as source, timestamp_ntz '2024-01-31 00:00:00' - make_dt_interval(0, h) as ts, h
                         from values ('A', 216), ('A', 241), ('B', 5), ('B', 216) t(stock, h)""")
    kept = posts_in_lookback(posts, with_lookback(stocks.select("stock"), stocks, hours=(6, 240)), v.now())
    assert sorted((r["stock"], r["h"]) for r in kept.collect()) == [("A", 216), ("B", 5)]


def test_totals_are_sums_over_sources(spark, sf_dir):
    rows = metrics.stock_sentiment_metrics(v.scored_posts(spark, sf_dir)).collect()
    for row in rows:
        counts = [row[f"nb_{s}"] for s in SOURCES]
        assert sum(counts) == row["total_nb"]
        total = sum(row[f"avg_{s}"] * n for s, n in zip(SOURCES, counts) if n)
        assert abs(total - row["total_avg"] * row["total_nb"]) < 1e-9


def test_scores_are_bounded(spark, sf_dir):
    wild = F.col("probability").isNull() | (F.abs("probability") > 1)
    assert v.scored_posts(spark, sf_dir).where(wild).isEmpty()


def test_sessions_do_not_overlap(spark, sf_dir):
    days = sessions.session_days(sessions.session_gap(v.prices(spark, sf_dir)))
    assert days.groupBy("ticker", "day").count().where("count > 1").isEmpty()


def test_both_session_forms_agree(spark, sf_dir):
    gaps = sessions.session_gap(v.prices(spark, sf_dir))
    summed = sessions.news_sessions(v.news(spark, sf_dir), gaps, minimum=1)
    listed = sessions.headline_sessions(v.news(spark, sf_dir), gaps).groupBy("ticker", "date")
    a = {(r["ticker"], r["date"]): (r["nb"], round(r["sentiment"], 9)) for r in summed.collect()}
    counted = listed.agg(F.count("*").alias("nb"), F.avg("score").alias("s"))
    assert a == {(r["ticker"], r["date"]): (r["nb"], round(r["s"], 9)) for r in counted.collect()}


def test_input_order_does_not_matter(spark, sf_dir):
    posts = v.scored_posts(spark, sf_dir)
    turned = posts.repartition(5, "text").sortWithinPartitions(F.desc("seq"))
    columns = ["stock", "total_nb", "nb_reddit", "nb_stocktwit", "nb_twitter"]
    a, b = (jobs.scored_posts_metrics(p).select(columns).collect() for p in (posts, turned))
    assert sorted(a) == sorted(b)


def test_staging_does_not_change_the_job(spark, sf_dir, tmp_path):
    from murmur.plans.queries import _social_inputs

    inputs = _social_inputs(spark, sf_dir)
    stocks = v.keywords(spark)
    plain = jobs.social_sentiment(*inputs, stocks, v.letter_model)
    written = jobs.social_sentiment(*inputs, stocks, v.letter_model, stage_dir=str(tmp_path / "stage"))
    shape = lambda df: sorted((r["stock"], r["total_nb"], round(r["total_avg"], 9)) for r in df.collect())
    assert shape(plain) == shape(written)


def test_headlines_in_spans_are_the_range_join(spark):
    """Spans of any length, overlapping, empty, reversed or open-ended."""
    import random
    from datetime import datetime, timedelta

    from murmur.operators.sessions import headlines_in_spans

    rng = random.Random(5)
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(0, 60 * 24 * 12, 15))
    news = [(i, rng.choice("AB"), None if rng.random() < 0.05 else at()) for i in range(300)]
    spans = []
    for i in range(60):
        opens = at()
        closes = rng.choice([opens, opens + timedelta(minutes=30), opens + timedelta(days=3), opens - timedelta(days=1), at(), None])
        spans.append((i, rng.choice("AB"), None if rng.random() < 0.05 else opens, closes))
    found = headlines_in_spans(
        spark.createDataFrame(news, "id int, ticker string, ts timestamp_ntz").repartition(3),
        spark.createDataFrame(spans, "span int, ticker string, opens timestamp_ntz, closes timestamp_ntz"),
    )
    expected = sorted((i, s) for i, t, ts in news for s, u, a, b in spans if t == u and None not in (ts, a, b) and a <= ts < b)
    assert sorted((r["id"], r["span"]) for r in found.collect()) == expected and len(expected) > 100
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
