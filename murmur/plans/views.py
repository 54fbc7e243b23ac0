"""Views that give the test tables the shape of the job's inputs.

``oracle.py`` has the same views in SQL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.numbers import net_sentiment
from murmur.operators import filters
from murmur.operators.dedup import with_source_order

NOW = "2024-01-31 00:00:00"

KEYWORDS = [("THE", ["The"]), ("IS", ["Is"]), ("ON", ["on"])]
KEYWORDS_MULTI = [("ARTICLES", ["The", "la", "of the"]), ("PREPOSITIONS", ["of the", "on", "in"]), ("MARKS", ["$$$", "Is"])]
HOLIDAYS = ["2024-01-01", "2024-01-15"]
LEXICON = [("the", 0.4), ("is", -1.1), ("on", 1.9), ("la", -0.8), ("der", 2.3), ("of", -0.3), ("not", -2.0)]

# Words of the test tables that stand for modifiers of a score.
MODIFIERS = {"negations": ("to", "en"), "stronger": ("that", "it"), "weaker": ("for", "with"), "contrast": ("and", "und")}


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _size(df: DataFrame) -> Column:
    """The number of rows, as a subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of 20 stocks from three sources, with model output."""
    documents = table(spark, sf_dir, "documents")
    embeddings = table(spark, sf_dir, "embeddings")
    third = F.col("doc_id") % 3
    tag = F.col("doc_id") % 5
    numbered = documents.withColumn("vec_id", F.col("doc_id") % _size(embeddings))
    return numbered.join(embeddings.select("vec_id", F.slice("embedding", 1, 3).alias("logits")), "vec_id").select(
        F.col("source").alias("stock"),
        F.when(third == 0, "reddit").when(third == 1, "stocktwit").otherwise("twitter").alias("source"),
        F.when(third != 0, F.concat(F.lit("u"), (F.col("doc_id") % 37).cast("string"))).alias("user"),
        "text",
        "lang",
        F.when(third == 1, F.when(tag < 2, "Bullish").when(tag < 4, "Bearish").otherwise("")).alias("directional"),
        F.col("doc_id").alias("seq"),
        (now() - F.make_dt_interval(F.lit(0), (F.col("doc_id") % 240).cast("int"), F.lit(30))).alias("ts"),
        "logits",
    )


def english_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reddit as it is, the other sources by the lenient language filter."""
    return filters.keep_english_lenient(posts(spark, sf_dir), exempt=("reddit",))


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English posts, cleaned and scored, in arrival order."""
    cleaned = with_source_order(filters.clean_and_drop_empty(english_posts(spark, sf_dir)))
    return cleaned.withColumn("probability", net_sentiment(F.col("logits"))).drop("logits")


def comments(spark: SparkSession, sf_dir: str, start: int | None = None) -> DataFrame:
    """Comments with a time; some removed, empty, a space, or only an address.

    Where bodies are only compared with something short, ``start`` leaves as many
    characters of a text before the texts meet the events.
    """
    documents = table(spark, sf_dir, "documents")
    texts = documents.select("doc_id", "text" if start is None else F.substring("text", 1, start).alias("text"))
    numbered = table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % _size(documents))
    body = (
        F.when(F.col("event_type") == "error", F.lit("[removed]"))
        .when(F.col("event_type") == "view", F.lit(""))
        .when(F.col("event_type") == "click", F.lit(" "))
        .when(F.col("event_type") == "signup", F.lit("https://a.example/b?c=1"))
        .otherwise(F.col("text"))
    )
    return numbered.join(texts, "doc_id").select(
        F.col("event_id").alias("seq"), "ts", body.alias("body")
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    numbered = table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % _size(documents))
    return numbered.join(documents.select("doc_id", "text", "lang"), "doc_id").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("ticker"),
        "ts",
        F.col("text").alias("headline"),
        "lang",
        F.col("value").alias("score"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday prices of five tickers: the last value of the day."""
    return (
        table(spark, sf_dir, "events")
        .where(F.weekday("ts") < 5)
        .groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"))
        .agg(F.max_by("value", "ts").alias("adj_close"))
    )


def price_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with all columns; volume is missing on some days."""
    volume = F.count(F.lit(1))
    return (
        table(spark, sf_dir, "events")
        .where(F.weekday("ts") < 5)
        .groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"))
        .agg(
            F.min_by("value", "ts").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.max_by("value", "ts").alias("adj_close"),
            F.when(F.dayofmonth(F.to_date(F.min("ts"))) != 17, volume).alias("volume"),
        )
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("pos"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.concat("p_name", F.lit(" Corp. A, "), "p_brand", F.lit(" Inc.")).alias("title"),
        F.col("p_size").alias("short_pct"),
    )


def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 5
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.when(kind == 0, F.lit("N/A"))
        .when(kind == 1, F.concat(price, F.lit("M")))
        .when(kind == 2, F.lit("1.5B"))
        .when(kind == 3, F.lit("2T"))
        .otherwise(F.lit("12k"))
        .alias("cap_text"),
        F.col("p_size").alias("short_pct"),
    )


def stocktwits_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("turn") % 3
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.concat_ws(
            "\n",
            F.concat(F.lit("user"), F.col("conv_id").cast("string")),
            F.when(line == 0, "Bullish").when(line == 1, "Bearish").otherwise("10:05 AM"),
            F.lit("10:05 AM"),
            "text",
        ).alias("raw"),
    )


def twitter_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.concat_ws("\n", F.concat(F.lit("user"), conv), F.concat(F.lit("@handle"), conv), F.lit("·"), F.lit("2h"), "text").alias(
            "raw"
        ),
    )


def screener_pages(spark: SparkSession, sf_dir: str, closed: bool = True) -> DataFrame:
    """Pages of 20 rows, as a stock screen shows them, behind a table for navigation."""
    end_cell, end_row = ("</td>", "</tr>") if closed else ("", "")

    def row(*cells: Column) -> Column:
        parts = [F.lit('<tr valign="top">')]
        for cell in cells:
            parts += [F.lit('<td align="left">'), cell, F.lit(end_cell)]
        return F.concat(*parts, F.lit(end_row))

    link = F.concat(F.lit('<a href="q?t=x">'), F.col("symbol"), F.lit("</a>"))
    rows = companies(spark, sf_dir).select(
        F.floor(F.col("pos") / 20).alias("page"),
        "pos",
        row(F.col("pos").cast("string"), link, F.replace(F.col("title"), F.lit(","), F.lit(" &amp;"))).alias("markup"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("pos", "markup")))
    header = row(F.lit("No."), F.lit("Ticker"), F.lit("Company"))
    return rows.groupBy("page").agg(
        F.concat(
            F.lit('<html><body><table><tr><td>1</td><td>NEWS</td><td>Menu</td></tr></table><table>'),
            header,
            F.array_join(F.transform(in_order, lambda r: r["markup"]), "\n"),
            F.lit("</table><table></table></body></html>"),
        ).alias("html")
    )


def statistics_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per stock, with its market cap first in the second table."""
    cells = [F.lit("<table><tr><td>Menu</td><td>Home</td></tr></table><table class='stats'><tr><td>Market cap</td><td><b>")]
    cells += [F.col("cap_text"), F.lit("</b></td></tr><tr><td>Volume</td><td>7M</td></tr></table>")]
    return caps(spark, sf_dir).select("symbol", F.concat(*cells).alias("html"))


def holiday_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per month, one column per year: the month's first order date."""
    years = [str(year) for year in range(1995, 2002)]
    year = F.date_format("o_orderdate", "yyyy")

    def cell(name: str) -> Column:
        first = F.min(F.when(year == name, F.col("o_orderdate")))
        return F.coalesce(F.date_format(first, "EEEE,  MMMM d"), F.lit("—*")).alias(name)

    month = F.month("o_orderdate").cast("string").alias("holiday")
    return table(spark, sf_dir, "orders").groupBy(month).agg(*[cell(name) for name in years])


def trending_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list per web page: its links."""
    link = r'<a href="([^"]*)">([^<]*)</a>'
    html = F.col("html")
    symbols = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("symbol"),
        F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("title"),
    )
    body = F.to_json(F.struct(symbols.alias("symbols")))
    return table(spark, sf_dir, "pages").select("page_id", body.alias("body"))


def keywords(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or KEYWORDS, "stock STRING, keywords ARRAY<STRING>")


def holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(day,) for day in HOLIDAYS], "day STRING").select(F.to_date("day").alias("date"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "token STRING, valence DOUBLE")


def letter_model():
    """A stand-in for a sentiment model: letters e against letters a."""

    def score(texts):
        return np.array([[t.count("e") / 100, 0.0, t.count("a") / 100] for t in texts])

    return score
