"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, and
``BENCH_QUERIES`` (comma-separated) picks other queries than the headline ones.
Each query runs once to warm the code generator and then ``BENCH_RUNS`` times;
the best run counts, and ``spread`` has the slowest as a multiple of it. Results
go to the no-op sink, so every row is computed.

The test tables are one row group each, so what comes before the first shuffle
is one task. ``skewed`` has seconds over ``BENCH_COPIES`` copies of the texts and
events in many files, a third of which are one text, one stock and one ticker.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from murmur.plans.queries import QUERIES  # noqa: E402
from murmur.session import local_session, shared_dir  # noqa: E402

HEADLINE = (
    "posts_lookback",
    "clean_post",
    "net_sentiment",
    "detect_language",
    "keyword_match",
    "keyword_match_multi",
    "dedup_staged",
    "stock_sentiment_metrics",
    "metrics_rollup",
    "score_posts_batch",
    "lexicon_score",
    "news_dedup",
    "news_sessions",
    "headline_sessions",
    "sentiment_next_return",
    "return_sentiment_corr",
    "post_sentiment_histogram",
    "html_rows",
    "universe_merge",
    "choose_universe",
    "position_signal",
    "social_sentiment",
    "news_vs_return",
)


SKEWED = (
    "keyword_match",
    "keyword_match_large_universe",
    "detect_language",
    "lexicon_score",
    "dedup_staged",
    "stock_sentiment_metrics",
    "score_posts_batch",
    "news_dedup",
    "news_sessions",
    "social_sentiment",
    "news_vs_return",
)
FILES = 16


def skewed_tables(spark, sf_dir: str, copies: int) -> str:
    """The tables with ``copies`` times the documents and events; every third row is hot."""
    path = shared_dir(spark, "bench")
    for name in ("documents", "events"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        key, hot = {"documents": ("doc_id", {"text": "text", "source": "source"}), "events": ("event_id", {"event_type": "event_type"})}[name]
        first = rows.orderBy(key).select(*[F.col(c).alias(f"_{c}") for c in hot]).limit(1)
        size = rows.count()
        many = rows.crossJoin(spark.range(copies)).withColumn(key, F.col(key) + F.col("id") * size).drop("id")
        many = many.crossJoin(F.broadcast(first))  # one row
        for column in hot:
            many = many.withColumn(column, F.when(F.col(key) % 3 == 0, F.col(f"_{column}")).otherwise(F.col(column)))
        many.select(rows.columns).repartition(FILES).write.parquet(f"{path}/{name}.parquet")
    for name in ("embeddings", "conversations"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    copies = int(os.environ.get("BENCH_COPIES", "10"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("murmur-bench", cores)
    seconds, spread = {}, {}
    for name in names:
        timed(spark, sf_dir, name)
        every = [timed(spark, sf_dir, name) for _ in range(runs)]
        seconds[name] = round(min(every), 3)
        spread[name] = round(max(every) / min(every), 2)
    skewed = {}
    if copies:
        path = skewed_tables(spark, sf_dir, copies)
        skewed = {name: round(timed(spark, path, name), 3) for name in SKEWED}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cores,
                "runs": runs,
                "spread": spread,
                "skewed_copies": copies,
                "skewed": skewed,
            }
        )
    )


if __name__ == "__main__":
    main()
