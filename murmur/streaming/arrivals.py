"""Posts and news taken in batch by batch, each batch's result replaced as a whole.

A table here is a folder with one folder a batch, ``batch=ID``. A batch is written
by its own id and reads only batches before it. So a batch that was interrupted,
or is run again after a restart, replaces what it left and changes nothing else,
which is what ``foreachBatch`` asks for: it may hand over a batch twice.

What is known of earlier posts is kept as such tables and met by joins, not as
state by key: a stock that most posts speak of would make one key's state as
large as the lookback, while rows of (stock, digest) spread.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from murmur.functions.text import text_digest
from murmur.operators.dedup import keep_first
from murmur.params import SOURCES
from murmur.sources.news import NEWS_SCHEMA, parse_news

ARRIVED = "stock STRING, source STRING, user STRING, digest BINARY, seq BIGINT, ts TIMESTAMP_NTZ, kept BOOLEAN"
PARTIALS = "stock STRING, source STRING, hour TIMESTAMP_NTZ, nb BIGINT, scored BIGINT, total DOUBLE"


# Tables of batches


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Make ``rows`` the whole of what the table holds of this batch."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before one; none if nothing was written yet."""
    kind = T.StructType.fromDDL(schema)
    try:
        rows = spark.read.schema(T.StructType([*kind.fields, T.StructField("batch", T.LongType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)
    if before is not None:
        rows = rows.where(F.col("batch") < before)  # by folder, without opening a file
    return rows.select([f.name for f in kind.fields])


# De-duplication on arrival


def _judged(new: DataFrame, earlier: DataFrame, source: str, null_user: str, users: bool) -> DataFrame:
    """Posts of one source that are no repeat of a text, and which of them are kept."""
    order = ["seq"]
    # a text hides later ones if its post was kept, or for as long as its own source arrives
    hidden = earlier.where(F.col("kept") | (F.col("source") == source)).select("stock", "digest")
    texts = keep_first(new, ["stock", "digest"], order).join(hidden.distinct(), ["stock", "digest"], "left_anti")
    if not users:
        return texts.withColumn("kept", F.lit(True))
    known = earlier.where("kept").select(F.col("stock").alias("_stock"), F.col("user").alias("_user")).distinct()
    known = known.where("_user is not null") if null_user == "keep" else known
    alone = F.col("user").isNull() if null_user == "keep" else F.lit(False)
    first = keep_first(texts, ["stock", "user", F.when(alone, F.col("seq"))], order).select("stock", "user", "seq")
    first = first.join(known, (F.col("stock") == F.col("_stock")) & F.col("user").eqNullSafe(F.col("_user")), "left_anti")
    first = first.select(F.col("stock").alias("_stock"), F.col("seq").alias("_seq"))
    met = texts.join(first, (F.col("stock") == F.col("_stock")) & (F.col("seq") == F.col("_seq")), "left")
    return met.withColumn("kept", F.col("_seq").isNotNull()).drop("_stock", "_seq")


def arrive(posts: DataFrame, path: str, batch: int, *, hours: int | None = None, null_user: str = "keep") -> None:
    """Judge one batch of posts against those before it, and note it in the table at ``path``.

    What ``dedup_staged`` says of all posts at once, for posts that arrive by
    source and, within a source, by ``seq``, cut into batches anywhere; posts of
    the first source have no user, as in ``prepare_posts``. With ``hours``, posts
    older than that before the batch's latest hide nothing any more. ``posts``:
    stock, source, user, text or digest, seq, ts; (stock, source, seq) names a
    post. Only digests are shuffled and stored.
    """
    spark = posts.sparkSession
    digest = F.col("digest") if "digest" in posts.columns else text_digest(F.col("text"))
    new = posts.select("stock", "source", "user", digest.alias("digest"), F.col("seq").cast("long").alias("seq"), "ts")
    earlier = read_batches(spark, path, ARRIVED, before=batch)
    if hours is not None:
        latest = new.agg(F.max("ts")).first()[0]
        if latest is not None:
            earlier = earlier.where(F.col("ts") >= F.lit(latest) - F.make_dt_interval(hours=F.lit(hours)))
    folder = f"{path}/batch={batch}"
    for place, source in enumerate(SOURCES):
        # each source is written before the next one reads it: judging it again for that would repeat all joins
        rows = _judged(new.where(F.col("source") == source), earlier, source, null_user, users=place > 0)
        rows = rows.select([f.name for f in T.StructType.fromDDL(ARRIVED).fields])
        rows.write.mode("overwrite" if place == 0 else "append").parquet(folder)
        earlier = earlier.unionByName(spark.read.schema(ARRIVED).parquet(folder).where(F.col("source") == source))


def arrived(spark: SparkSession, path: str) -> DataFrame:
    """The posts that are kept so far."""
    return read_batches(spark, path, ARRIVED).where("kept").drop("kept")


def dedup_on_arrival(stream: DataFrame, path: str, checkpoint: str, *, hours: int | None = None, null_user: str = "keep") -> StreamingQuery:
    """Take what has landed so far, batch by batch, through ``arrive``."""
    work = lambda rows, batch: arrive(rows, path, batch, hours=hours, null_user=null_user)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Metrics that can be merged


def partial_metrics(posts: DataFrame) -> DataFrame:
    """Sums by stock, source and hour, from which the metrics of any span of hours follow."""
    return posts.groupBy("stock", "source", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("nb"), F.count("probability").alias("scored"), F.sum("probability").alias("total")
    )


def merged_metrics(partials: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The metrics row of every stock over the hours from ``since`` to before ``until``.

    Batches may each hold a part of an hour; sums are merged here, and hours that
    have left the lookback are not read.
    """
    if since is not None:
        partials = partials.where(F.col("hour") >= since)
    if until is not None:
        partials = partials.where(F.col("hour") < until)

    def mean(where: Column | None = None) -> Column:
        of = (lambda c: F.col(c)) if where is None else (lambda c: F.when(where, F.col(c)))
        return F.try_divide(F.sum(of("total")), F.sum(of("scored")))

    per_source = []
    for source in SOURCES:
        here = F.col("source") == source
        per_source.append(mean(here).alias(f"avg_{source}"))
        per_source.append(F.coalesce(F.sum(F.when(here, F.col("nb"))), F.lit(0).cast("long")).alias(f"nb_{source}"))
    return partials.groupBy("stock").agg(
        mean().alias("total_avg"), F.sum("nb").alias("total_nb"), F.lit(None).cast("double").alias("accuracy"), *per_source
    )


# News


def load_news_on_arrival(spark: SparkSession, landing: str, path: str, checkpoint: str, *, files_per_batch: int = 1000) -> StreamingQuery:
    """News files that have landed since the last run, as batches of the table at ``path``.

    Records are as in ``read_news_json``. A file is read once, however often and
    wherever the load stops; ``news_of`` reads the table.
    """
    stream = spark.readStream.schema("value STRING, ticker STRING").option("maxFilesPerTrigger", files_per_batch).text(landing)
    work = lambda lines, batch: write_batch(parse_news(lines), path, batch)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def news_of(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, "ticker STRING, " + NEWS_SCHEMA)
