"""The query registry: every operator over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import labels, ngrams, numbers
from murmur.functions import text as tx
from murmur.functions.language import with_language
from murmur.operators import calendar, dedup, filters, match, metrics, scoring, sessions, signals, universe, valence
from murmur.params import REMOVED_BODY, SOURCES
from murmur.plans import jobs
from murmur.plans import views as v
from murmur.session import shared_dir
from murmur.sources import holidays as hol
from murmur.sources import grids, html, posts, prices, sinks, trending
from murmur.sources import news as news_source
from murmur.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(*names: str) -> list[Column]:
    """Doubles to six places; adding zero turns -0.0 into 0.0."""
    return [(F.round(F.col(name), 6) + F.lit(0.0)).alias(name) for name in names]


METRICS = ("total_nb", "nb_reddit", "nb_stocktwit", "nb_twitter")
MEANS = ("total_avg", "accuracy", "avg_reddit", "avg_stocktwit", "avg_twitter")


# Scans, sources, sinks


@query
def posts_lookback(spark, sf):
    taken = posts.posts_in_window(v.comments(spark, sf), v.now(), 168)
    return taken.select("seq", "ts", "body")


@query
def cap_input(spark, sf):
    """Bodies are only compared with the mark of a removed post, so no more than tells them apart is shuffled."""
    heads = v.comments(spark, sf, start=len(REMOVED_BODY) + 1)
    taken = posts.posts_in_window(heads, v.now(), 24 * 30)
    return posts.cap_posts(taken.select("seq", "ts"), limit=1000)


@query
def parse_twitter_post(spark, sf):
    return posts.parse_twitter(v.twitter_raw(spark, sf)).select("conv_id", "turn", "user", "text")


@query
def parse_stocktwits_post(spark, sf):
    return posts.parse_stocktwits(v.stocktwits_raw(spark, sf)).select("conv_id", "turn", "user", "directional", "text")


@query
def news_load(spark, sf):
    """Land news as JSON lines, load it, write the table, read it back."""
    events = v.table(spark, sf, "events")
    record = events.select(
        F.col("event_type").alias("category"),
        labels.wall_seconds(F.col("ts")).alias("datetime"),
        F.concat_ws(" ", "event_type", "props").alias("headline"),
        F.col("event_id").alias("id"),
        F.lit("").alias("image"),
        F.col("event_type").alias("related"),
        F.lit("wire").alias("source"),
        F.col("props").alias("summary"),
        F.concat(F.lit("https://n.example/"), F.col("event_id").cast("string")).alias("url"),
    )
    landing, target = shared_dir(spark, "news_landing"), shared_dir(spark, "news")
    record.select(F.col("related").alias("ticker"), F.to_json(F.struct("*")).alias("value")).write.partitionBy(
        "ticker"
    ).text(landing)
    news_source.write_news(news_source.read_news_json(spark, landing), target)
    return news_source.read_news(spark, target)


@query
def trending_flatten(spark, sf):
    lists = v.trending_lists(spark, sf)
    return trending.flatten_trending(lists, F.col("body")).select("page_id", "pos", "symbol", "title")


@query
def trending_top_n(spark, sf):
    lists = v.trending_lists(spark, sf)
    listed = trending.flatten_trending(lists, F.col("body"))
    return trending.take_trending(listed, limit=5).select("page_id", "pos", "symbol")


@query
def html_rows(spark, sf):
    """Lists in web pages: a row per list, a cell per item."""
    pages = v.table(spark, sf, "pages").select("page_id", "html")
    found = html.html_rows(pages, F.col("html"), r"(?s)<ul>(.*?)</ul>", r"(?s)<li>(.*?)</li>")
    return found.select("page_id", "row_no", F.size("cells").alias("nb"), F.array_join("cells", "|").alias("cells"))


@query
def screener_rows(spark, sf):
    return html.screener_rows(v.screener_pages(spark, sf), "page")


@query
def screener_rows_lenient(spark, sf):
    return html.screener_rows(v.screener_pages(spark, sf, closed=False), "page", closed=False)


@query
def table_grid(spark, sf):
    """A page a nation: its key beside all its suppliers, each with a table of its own in a cell; end tags are left out."""
    suppliers = v.table(spark, sf, "supplier")
    row = F.concat(
        F.lit("<td>"), "s_name", F.lit("<table class=inner><tr><td>"), F.col("s_suppkey").cast("string"), F.lit("</table><td>"), F.lit("#"),
        F.col("s_suppkey").cast("string"),
    )
    rows = F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row"))))
    pages = suppliers.groupBy(F.col("s_nationkey").alias("page_id")).agg(rows.alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "<tr>")
    head = F.concat(F.lit("<table class='wide main'><tr><th rowspan="), F.size("rows").cast("string"), F.lit(">"), F.col("page_id").cast("string"))
    pages = pages.select("page_id", F.concat(head, body, F.lit("</table>")).alias("html"))
    return grids.table_grids(pages, "page_id", class_name="main").select("page_id", "row", "col", "text")


@query
def index_members(spark, sf):
    rows = html.html_rows(v.screener_pages(spark, sf), F.col("html"), html.row_with(*html.SCREEN_ROW))
    return html.index_members(rows).select("page", "row_no", "ticker")


@query
def page_caps(spark, sf):
    """Market caps in the statistics tables of the stocks' pages."""
    pages = v.statistics_pages(spark, sf)
    return html.first_cell_after_label(pages, F.col("html"), "cap_text", "stats").select("symbol", "cap_text")


@query
def holiday_unpivot(spark, sf):
    return hol.holidays_long(v.holiday_table(spark, sf)).select("holiday", "date")


@query
def metrics_csv_roundtrip(spark, sf):
    path = shared_dir(spark, "metrics")
    sinks.write_metrics_csv(jobs.scored_posts_metrics(v.scored_posts(spark, sf)), path)
    return sinks.read_metrics_csv(spark, path).select("stock", *METRICS, *rounded(*MEANS))


# Projections, filters


@query
def lang_filter_lenient(spark, sf):
    return v.english_posts(spark, sf).select("stock", "source", "seq", "lang")


@query
def lang_filter_strict(spark, sf):
    return filters.keep_english_strict(v.news(spark, sf)).select("id", "ticker", "lang")


@query
def lang_filter_strict_by_value(spark, sf):
    return filters.drop_foreign_headlines(v.news(spark, sf)).select("id", "ticker", "lang")


@query
def drop_empty_clean(spark, sf):
    return filters.clean_and_drop_empty(v.comments(spark, sf), "body").select("seq", "body")


@query
def news_drop_blank(spark, sf):
    """Headlines of low scores are missing or spaces, times of one hour are missing."""
    headline = F.when(F.col("score") >= 2, F.col("headline")).when(F.col("score") >= 1, F.lit("   "))
    at = F.when(F.hour("ts") != 3, F.col("ts"))
    gaps = v.news(spark, sf).withColumns({"headline": headline, "datetime": at})
    return filters.drop_blank_news(gaps).select("id", "ticker", F.length("headline").cast("bigint").alias("chars"))


@query
def dropna_any(spark, sf):
    documents = v.table(spark, sf, "documents").select("doc_id", "source")
    marked = documents.join(v.table(spark, sf, "labels"), "doc_id", "left")
    return prices.drop_incomplete(marked).select("doc_id", "source", "quality", "toxic")


@query
def price_range(spark, sf):
    start, end = F.lit("2024-01-08").cast("date"), F.lit("2024-01-19").cast("date")
    return prices.in_range(v.prices(spark, sf), start, end).select("ticker", "date", *rounded("adj_close"))


@query
def adjusted_close(spark, sf):
    start, end = F.lit("2024-01-08").cast("date"), F.lit("2024-01-26").cast("date")
    return prices.adjusted_close(v.price_bars(spark, sf), start, end).select("ticker", "date", *rounded("adj_close"))


@query
def min_cap_filter(spark, sf):
    return filters.keep_min_cap(v.caps(spark, sf)).select("symbol", "cap_text", "cap")


@query
def short_level_filter(spark, sf):
    return filters.keep_shorted(v.caps(spark, sf)).select("symbol", "short_pct")


# Joins


def _matched(spark, sf, keywords=None, **options):
    documents = v.table(spark, sf, "documents").select("doc_id", "text")
    universe_ = v.keywords(spark, keywords)
    return match.keyword_match(documents, universe_, **options).select("doc_id", "stock", "keyword")


@query
def keyword_match(spark, sf):
    return _matched(spark, sf)


@query
def keyword_match_multi(spark, sf):
    return _matched(spark, sf, v.KEYWORDS_MULTI)


@query
def keyword_match_large_universe(spark, sf):
    """The form for universes too large to broadcast."""
    return _matched(spark, sf, v.KEYWORDS_MULTI, max_broadcast_rows=0)


@query
def keyword_match_any(spark, sf):
    return _matched(spark, sf, v.KEYWORDS_MULTI, all_occurrences=True)


def _session_scores(spark, sf):
    gaps = sessions.session_gap(v.prices(spark, sf))
    return sessions.news_sessions(v.news(spark, sf), gaps)


@query
def news_sessions(spark, sf):
    return _session_scores(spark, sf).select("ticker", "date", "next_date", "nb", *rounded("sentiment"))


@query
def headline_sessions(spark, sf):
    gaps = sessions.session_gap(v.prices(spark, sf))
    return sessions.headline_sessions(v.news(spark, sf), gaps).select("id", "ticker", "date", "next_date")


@query
def headlines_in_spans(spark, sf):
    """Headlines by session where every third day opens at an hour of its own."""
    day = F.to_date("ts")
    delay = F.make_dt_interval(F.lit(0), F.lit(6) + F.day(day) % 7, F.day(day) % 5 * 11)
    openings = v.table(spark, sf, "events").where(F.day(day) % 3 == 0).select(day.alias("date")).distinct()
    openings = openings.withColumn("ts", F.col("date").cast("timestamp_ntz")).select("date", (F.col("ts") + delay).alias("opens"))
    spans = sessions.session_spans(sessions.session_gap(v.prices(spark, sf)), openings)
    found = sessions.headlines_in_spans(v.news(spark, sf), spans)
    return found.select("id", "ticker", "date", "next_date", "opens", "closes")


def _returns_with_sentiment(spark, sf):
    returns = sessions.daily_return(v.prices(spark, sf))
    return sessions.sentiment_next_return(returns, _session_scores(spark, sf))


@query
def sentiment_next_return(spark, sf):
    return _returns_with_sentiment(spark, sf).select("ticker", "date", *rounded("adj_close", "daily_return", "sentiment"))


def _trending_flags(spark, sf):
    return v.companies(spark, sf).where(F.col("short_pct") >= 25).select(
        F.col("symbol").alias("stock"), (F.col("short_pct") >= 40).alias("is_trending")
    )


@query
def stock_lookback(spark, sf):
    stocks = v.caps(spark, sf).select(F.col("symbol").alias("stock"))
    return universe.with_lookback(stocks, _trending_flags(spark, sf)).select("stock", "is_trending", "lookback")


@query
def posts_lookback_by_stock(spark, sf):
    every = v.posts(spark, sf)
    stocks = every.select("stock").distinct()
    flags = stocks.select("stock", F.col("stock").rlike("[02468]$").alias("is_trending"))
    hours = universe.with_lookback(stocks, flags)
    return universe.posts_in_lookback(every, hours, v.now()).select("stock", "source", "seq", "ts")


@query
def open_days(spark, sf):
    days = v.prices(spark, sf)
    return calendar.open_days(days, v.holidays(spark)).select("ticker", "date", *rounded("adj_close"))


@query
def holiday_days(spark, sf):
    days = v.prices(spark, sf)
    return calendar.holiday_days(days, v.holidays(spark)).select("ticker", "date", *rounded("adj_close"))


# Aggregations, de-duplication


@query
def nb_comments(spark, sf):
    return metrics.nb_comments(v.scored_posts(spark, sf))


@query
def average_sentiment(spark, sf):
    return metrics.average_sentiment(v.scored_posts(spark, sf)).select("stock", "source", *rounded("avg"))


@query
def stock_sentiment_metrics(spark, sf):
    return jobs.scored_posts_metrics(v.scored_posts(spark, sf)).select("stock", *METRICS, *rounded(*MEANS))


@query
def stock_sentiment_metrics_collapse(spark, sf):
    """Posts without a user count as one user's."""
    rows = jobs.scored_posts_metrics(v.scored_posts(spark, sf), null_user="collapse")
    return rows.select("stock", *METRICS, *rounded(*MEANS))


@query
def metrics_rollup(spark, sf):
    return metrics.metrics_rollup(v.scored_posts(spark, sf)).select("stock", "source", "nb", *rounded("avg"))


@query
def dedup_text(spark, sf):
    return dedup.dedup_text(v.scored_posts(spark, sf)).select("stock", "source", "seq")


@query
def dedup_user(spark, sf):
    return dedup.dedup_user(v.scored_posts(spark, sf)).select("stock", "source", "seq")


@query
def dedup_user_collapse(spark, sf):
    return dedup.dedup_user(v.scored_posts(spark, sf), "collapse").select("stock", "source", "seq")


@query
def dedup_staged(spark, sf):
    return dedup.dedup_staged(v.scored_posts(spark, sf)).select("stock", "source", "user", "text", "seq")


@query
def dedup_staged_collapse(spark, sf):
    return dedup.dedup_staged(v.scored_posts(spark, sf), null_user="collapse").select("stock", "source", "seq")


@query
def dedup_single_pass(spark, sf):
    return dedup.dedup_single_pass(v.scored_posts(spark, sf), null_user="collapse").select("stock", "source", "seq")


@query
def news_dedup(spark, sf):
    return dedup.dedup_headlines(v.news(spark, sf)).select("id", "ticker")


@query
def return_sentiment_corr(spark, sf):
    return metrics.return_sentiment_corr(_returns_with_sentiment(spark, sf)).select("ticker", "nb", *rounded("corr"))


@query
def sentiment_histogram(spark, sf):
    bins = metrics.sentiment_histogram(_session_scores(spark, sf), "sentiment")
    return bins.select("bin", "n", *rounded("left_edge", "right_edge"))


@query
def post_sentiment_histogram(spark, sf):
    bins = metrics.sentiment_histogram(v.scored_posts(spark, sf), "probability")
    return bins.select("bin", "n", *rounded("left_edge", "right_edge"))


@query
def directional_accuracy(spark, sf):
    return metrics.directional_accuracy(v.scored_posts(spark, sf)).select("stock", "nb_tagged", *rounded("accuracy"))


# Windows, top-k, set operations


@query
def daily_return(spark, sf):
    return sessions.daily_return(v.prices(spark, sf)).select("ticker", "date", *rounded("adj_close", "daily_return"))


@query
def session_gap(spark, sf):
    return sessions.session_gap(v.prices(spark, sf)).select("ticker", "date", "next_date", "gap")


@query
def take_until_repeat(spark, sf):
    listed = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker")
    )
    return universe.take_until_repeat(listed).select("pos", "ticker")


@query
def posts_union(spark, sf):
    every = v.posts(spark, sf).select("stock", "source", "user", "seq", "directional")
    parts = [
        every.where(F.col("source") == "reddit").drop("user", "directional"),
        every.where(F.col("source") == "stocktwit"),
        every.where(F.col("source") == "twitter").drop("directional"),
    ]
    return posts.union_posts(*parts).select("stock", "source", "user", "seq", "directional")


def _two_lists(spark, sf):
    every = v.companies(spark, sf)
    shorted = every.where(F.col("short_pct") >= 30).withColumn("title", F.concat("title", F.lit(" Holdings Ltd")))
    busy = every.where(F.col("short_pct").between(20, 39))
    return universe.normalize_company(busy), universe.normalize_company(shorted)


@query
def universe_merge(spark, sf):
    busy, shorted = _two_lists(spark, sf)
    merged = universe.universe_merge((busy, True), (shorted, False))
    return merged.select("symbol", "is_trending", "name", F.array_join("keywords", "|").alias("keywords"))


@query
def universe_except(spark, sf):
    busy, shorted = _two_lists(spark, sf)
    return universe.universe_except(busy, shorted).select("symbol", "name")


# Scalar functions


@query
def clean_post(spark, sf):
    return v.posts(spark, sf).select("seq", tx.clean_post(F.col("text")).alias("text"))


@query
def clean_headline(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tx.clean_headline(F.col("text")).alias("headline"))


@query
def normalize_company(spark, sf):
    return universe.normalize_company(v.companies(spark, sf)).select("symbol", "name", "keyword")


@query
def net_sentiment(spark, sf):
    scored = v.table(spark, sf, "embeddings").select(
        "vec_id", numbers.net_sentiment(F.col("embedding")).alias("probability")
    )
    return scored.select("vec_id", *rounded("probability"))


@query
def parse_market_cap(spark, sf):
    return v.caps(spark, sf).select("symbol", "cap_text", numbers.market_cap(F.col("cap_text")).alias("cap"))


@query
def age_label(spark, sf):
    hours = F.floor((labels.wall_seconds(v.now()) - labels.wall_seconds(F.col("ts"))) / 3600)
    return v.table(spark, sf, "events").select("event_id", labels.age_label(v.now(), hours).alias("label"))


@query
def post_time_label(spark, sf):
    at = F.lit("2024-01-30 23:59:59").cast("timestamp_ntz")
    return v.table(spark, sf, "events").select("event_id", labels.post_time_label(F.col("ts"), at).alias("label"))


def _search_times(spark, sf):
    """Per ticker and day, the latest event as the time of the search."""
    lookback = F.when(F.col("ticker").isin("view", "click"), 6).otherwise(168)
    return (
        v.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"))
        .agg(F.max("ts").alias("now"))
        .withColumn("lookback", lookback)
    )


@query
def label_spine(spark, sf):
    spine = _search_times(spark, sf).select(
        "ticker", "date", "now", F.posexplode(labels.age_label_hours(F.col("lookback"))).alias("place", "hours")
    )
    return spine.select("ticker", "date", "place", labels.age_label(F.col("now"), F.col("hours")).alias("label"))


@query
def post_time_spine(spark, sf):
    spine = _search_times(spark, sf).select(
        "ticker",
        "date",
        "now",
        F.posexplode(labels.post_time_spine(F.col("now"), F.col("lookback"))).alias("place", "at"),
    )
    return spine.select("ticker", "date", "place", labels.post_time_label(F.col("at"), F.col("now")).alias("label"))


@query
def day_spine(spark, sf):
    spans = (
        v.table(spark, sf, "events")
        .groupBy("user_id")
        .agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))
    )
    return spans.select(
        "user_id",
        labels.days_apart(F.col("start"), F.col("end")).alias("days"),
        F.explode(labels.day_spine(F.col("start"), F.col("end"))).alias("date"),
    )


@query
def lookback_hours(spark, sf):
    days = v.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("date"))
    return calendar.lookback_hours(days, v.holidays(spark), base=24).select("event_id", "date", "hours")


# Scoring, decisions


@query
def score_posts_batch(spark, sf):
    cleaned = filters.clean_and_drop_empty(v.english_posts(spark, sf).drop("logits"))
    scored = scoring.score_posts_batch(cleaned, v.letter_model)
    return scored.select("stock", "source", "seq", *rounded("probability"))


@query
def detect_language(spark, sf):
    return with_language(v.table(spark, sf, "documents"), "text", "found").select("doc_id", "lang", "found")


@query
def detect_language_learned(spark, sf):
    """Every text's language by a model that four of five labelled texts teach; the others are held out."""
    docs = v.table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.col("doc_id") % 5 == 0
    model = ngrams.learn(docs.where(~held_out))
    known = with_language(docs, "text", "found", by=ngrams.learned_language(model))
    return known.select("doc_id", "lang", "found", held_out.alias("held_out"))


@query
def lexicon_score(spark, sf):
    headlines = v.table(spark, sf, "documents").select("doc_id", "text")
    scored = scoring.lexicon_score(headlines, v.lexicon(spark), keys=["doc_id"], text="text")
    return scored.select("doc_id", *rounded("compound"))


@query
def lexicon_score_rules(spark, sf):
    """The lexicon score with negation, degree, capitals, contrast and marks."""
    texts = v.table(spark, sf, "documents").select("doc_id", "text")
    rules = valence.Modifiers(**v.MODIFIERS)
    scored = valence.rule_score(texts, v.lexicon(spark), keys=["doc_id"], text="text", rules=rules)
    return scored.select("doc_id", *rounded("compound"))


@query
def position_signal(spark, sf):
    rows = jobs.scored_posts_metrics(v.scored_posts(spark, sf))
    kind = F.max("doc_id") % 3
    positions = (
        v.table(spark, sf, "documents")
        .groupBy(F.col("source").alias("stock"))
        .agg(F.when(kind == 0, "long").when(kind == 1, "short").alias("held"))
        .where(F.col("held").isNotNull())
    )
    return signals.position_signal(rows, positions, min_comments=5, entry=0.5, hold=0.2)


@query
def position_history(spark, sf):
    """Positions of every stock carried over the days of its posts."""
    posts_ = v.scored_posts(spark, sf)
    daily = posts_.groupBy("stock", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("total_nb"), F.avg("probability").alias("total_avg")
    )
    return signals.position_history(daily, min_comments=2, entry=0.9, hold=0.2)


@query
def dedup_on_arrival(spark, sf):
    """The posts in six batches, by source and in order, each judged against those before it."""
    path = shared_dir(spark, "arrivals")
    rows = v.scored_posts(spark, sf)
    half = rows.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for place, source in enumerate(SOURCES):
        for later in (False, True):
            batch = rows.where((F.col("source") == source) & ((F.col("seq") > half) == later))
            arrivals.arrive(batch, path, 2 * place + later)
    return arrivals.arrived(spark, path).select("stock", "source", "seq")


@query
def metrics_sliding(spark, sf):
    """Metrics of the last 72 hours at five times two days apart, from sums that read each post once."""
    path = shared_dir(spark, "partials")
    rows = v.scored_posts(spark, sf)
    day = lambda n: v.now() - F.make_dt_interval(days=F.lit(n))
    ends = [8, 6, 4, 2, 0]
    out = []
    for batch, end in enumerate(ends):
        new = rows.where(F.col("ts") < day(end))
        if batch:
            new = new.where(F.col("ts") >= day(ends[batch - 1]))
        arrivals.write_batch(arrivals.partial_metrics(new), path, batch)
        held = arrivals.read_batches(spark, path, arrivals.PARTIALS, before=batch + 1)
        metrics_ = arrivals.merged_metrics(held, since=day(end + 3), until=day(end))
        out.append(metrics_.select(F.lit(end).alias("days_ago"), "stock", *rounded(*MEANS), *METRICS))
    return reduce(DataFrame.union, out)


@query
def enough_comments(spark, sf):
    rows = filters.enough_comments(metrics.stock_sentiment_metrics(v.scored_posts(spark, sf)), 36)
    return rows.select("stock", "total_nb")


# Jobs


def _company_lists(spark, sf):
    every = v.companies(spark, sf)
    busy = every.where(F.col("short_pct") >= 40).select("pos", "symbol", "title")
    return busy, every


@query
def choose_universe(spark, sf):
    busy, screen = _company_lists(spark, sf)
    chosen = jobs.choose_universe(busy, screen, v.caps(spark, sf))
    return chosen.select("symbol", "is_trending", "name", F.array_join("keywords", "|").alias("keywords"), "cap")


def _social_inputs(spark, sf):
    """Documents as comments; users' turns as Stocktwits, the others as Twitter."""
    names = F.array(*[F.lit(stock) for stock, _ in v.KEYWORDS])
    stock = F.get(names, (F.col("conv_id") % len(v.KEYWORDS)).cast("int")).alias("stock")
    number = (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")
    is_user = F.col("role") == "user"
    comments = v.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("body"))
    stocktwits = v.stocktwits_raw(spark, sf).where(is_user).select(stock, number, "raw")
    twitter = v.twitter_raw(spark, sf).where(~is_user).select(stock, number, "raw")
    return comments, stocktwits, twitter


@query
def social_sentiment(spark, sf):
    stocks = v.keywords(spark, [*v.KEYWORDS, ("SILENT", ["no such word"])])
    rows = jobs.social_sentiment(*_social_inputs(spark, sf), stocks, v.letter_model, stage_dir=shared_dir(spark, "posts"))
    return rows.select("stock", *METRICS, *rounded(*MEANS))


@query
def news_vs_return(spark, sf):
    start, end = F.lit("2024-01-03").cast("date"), F.lit("2024-01-29").cast("date")
    unlabelled = v.news(spark, sf).drop("lang", "score")
    rows = jobs.news_vs_return(unlabelled, v.price_bars(spark, sf), v.lexicon(spark), start, end, minimum=5)
    return rows.select("ticker", "date", *rounded("adj_close", "daily_return", "sentiment"))
