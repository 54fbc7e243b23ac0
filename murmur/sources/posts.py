"""Post tables: time window, cap, raw-post parsing, union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions import text as tx
from murmur.params import COMMENT_LIMIT, REMOVED_BODY
from murmur.session import shared_dir

# Posts that one task may sort for a cap, and buckets of equal width that the ties are counted in.
SORTED_POSTS = 10_000
TIE_RANGES = 1000

COMMENT_SCHEMA = "id BIGINT, created_utc BIGINT, body STRING"
RAW_SCHEMA = "stock STRING, seq BIGINT, created_utc BIGINT, raw STRING"


def _with_time(df: DataFrame) -> DataFrame:
    at = F.timestamp_seconds("created_utc").cast("timestamp_ntz")
    return df.withColumn("ts", at).drop("created_utc")


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments of the followed forum: seq, body, ts."""
    return _with_time(spark.read.schema(COMMENT_SCHEMA).json(path)).withColumnRenamed("id", "seq")


def read_raw_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts as their pages showed them: stock, seq, raw, ts."""
    return _with_time(spark.read.schema(RAW_SCHEMA).json(path))


def posts_in_window(posts: DataFrame, now: Column, hours: int, *, ts: str = "ts", body: str = "body") -> DataFrame:
    """Posts of ``[now - hours, now)``, whole seconds, less removed ones.

    The time test is on the bare column, so it reaches the scan.
    """
    before = F.date_trunc("second", now).cast(posts.schema[ts].dataType)
    after = before - F.make_dt_interval(F.lit(0), F.lit(hours))
    return posts.where((F.col(ts) >= after) & (F.col(ts) < before) & ~F.col(body).eqNullSafe(F.lit(REMOVED_BODY)))


def _literal(value, kind: T.DataType) -> Column:
    return F.lit(value.isoformat() if isinstance(kind, T.TimestampNTZType) and value is not None else value).cast(kind)


def _reached(posts: DataFrame, bucket: Column, limit: int) -> tuple | None:
    """The bucket in which a running count reaches ``limit``, and the posts before it."""
    per = posts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    running = per.withColumn("upto", F.sum("n").over(Window.orderBy("bucket")))
    row = running.where(F.col("upto") >= limit).orderBy("bucket").first()
    return row and (row["bucket"], row["upto"] - row["n"])


def cap_posts(posts: DataFrame, *, ts: str = "ts", tie: str = "seq", limit: int = COMMENT_LIMIT) -> DataFrame:
    """The first ``limit`` posts by time, then by ``tie``, a number.

    A plain sort-and-limit would send ``limit`` rows of every partition to one
    task. Counts by hour, then by minute and second of where the cap falls, then
    by ever narrower ranges of ``tie``, leave at most ``SORTED_POSTS`` rows to be
    sorted, also when all posts share one second. A running count sees the hours
    there are, or at most ``TIE_RANGES`` buckets; a few small jobs run while the
    plan is built.

    However much it costs to get the posts, they are got once for these jobs,
    which read times and ties from the shared folder, and once more for the
    posts up to the cap, unless they have no other column.
    """
    path = shared_dir(posts.sparkSession, "cap")
    keys = posts.select(ts, tie)
    keys.write.parquet(path)
    keys = posts.sparkSession.read.schema(keys.schema).parquet(path)
    kind = {name: keys.schema[name].dataType for name in (ts, tie)}
    source = keys.select(posts.columns) if set(posts.columns) == {ts, tie} else posts
    left, near = limit, keys

    def narrow(bucket: Column, of: T.DataType) -> bool:
        nonlocal near, left
        found = _reached(near, bucket, left)
        if found is None:
            return False
        near, left = near.where(bucket.eqNullSafe(_literal(found[0], of))), left - found[1]
        return True

    if limit <= 0:
        return source.limit(0)
    for unit in ("hour", "minute", "second"):
        if not narrow(F.date_trunc(unit, F.col(ts)).cast(kind[ts]), kind[ts]):
            return source  # there are no more than the limit
    sizes = near.agg(F.count(F.lit(1)).alias("n"), F.min(tie).alias("low"), F.max(tie).alias("high"), F.max(ts).eqNullSafe(F.min(ts)).alias("same"))
    row = sizes.first()
    while row["same"] and row["n"] > SORTED_POSTS and row["low"] != row["high"]:
        step = max(1, (row["high"] - row["low"]) // TIE_RANGES + 1)
        narrow(F.floor((F.col(tie) - F.lit(row["low"])) / F.lit(step)), T.LongType())
        row = near.agg(F.count(F.lit(1)).alias("n"), F.min(tie).alias("low"), F.max(tie).alias("high"), F.lit(True).alias("same")).first()
    cut = near.orderBy(ts, tie).limit(left).agg(F.max(F.struct(ts, tie)).alias("cut")).first()["cut"]

    def is_before(name: str) -> Column:  # NULL comes first
        return F.lit(False) if cut[name] is None else F.coalesce(F.col(name) < _literal(cut[name], kind[name]), F.lit(True))

    same_time, same_tie = (F.col(name).eqNullSafe(_literal(cut[name], kind[name])) for name in (ts, tie))
    before = is_before(ts) | (same_time & is_before(tie))
    last = same_time & same_tie
    seen = near.agg(F.count_if(before).alias("before"), F.count_if(last).alias("last")).first()
    if seen["before"] + seen["last"] <= left:
        return source.where(before | last)
    return source.where(before).unionByName(source.where(last).limit(left - seen["before"]))  # as many of the alike as fit


def parse_twitter(raw_posts: DataFrame, raw: str = "raw") -> DataFrame:
    """Landed Twitter posts to user and text, each post with its own user."""
    return raw_posts.withColumns(
        {
            "source": F.lit("twitter"),
            "user": tx.twitter_user(F.col(raw)),
            "text": tx.twitter_text(F.col(raw)),
            "directional": F.lit(None).cast("string"),
        }
    ).drop(raw)


def parse_stocktwits(raw_posts: DataFrame, raw: str = "raw") -> DataFrame:
    """Landed Stocktwits posts to user, tag and text; too short a post has no text."""
    return raw_posts.withColumns(
        {
            "source": F.lit("stocktwit"),
            "user": tx.stocktwits_user(F.col(raw)),
            "text": tx.stocktwits_text(F.col(raw)),
            "directional": tx.stocktwits_directional(F.col(raw)),
        }
    ).drop(raw)


def union_posts(*parts: DataFrame) -> DataFrame:
    """Posts of several sources in one table; a column a source lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
