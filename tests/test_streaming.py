"""Streams give what the same functions give on a table."""

import datetime as dt

from pyspark.sql import functions as F

from murmur.plans import views as v
from murmur.streaming import posts as streaming


def land(df, folder, name):
    df.coalesce(2).write.json(str(folder / name))


def test_prepared_posts(spark, sf_dir, tmp_path):
    stock = F.lit("S").alias("stock")
    number = (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")
    is_user = F.col("role") == "user"
    stocktwits = v.stocktwits_raw(spark, sf_dir).where(is_user).select(stock, number, "raw")
    twitter = v.twitter_raw(spark, sf_dir).where(~is_user).select(stock, number, "raw")
    land(stocktwits, tmp_path, "stocktwits")
    land(twitter, tmp_path, "twitter")
    schema = "stock STRING, seq BIGINT, raw STRING"
    streams = [streaming.landed_posts(spark, str(tmp_path / n), schema, files_per_batch=1) for n in ("stocktwits", "twitter")]
    query = streaming.write_stream(
        streaming.prepared_posts(*streams), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("seq", "source", "text")
    expected = streaming.prepared_posts(stocktwits, twitter).select("seq", "source", "text")
    assert expected.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_lookback_metrics_drops_late_posts(spark, tmp_path):
    schema = "stock STRING, source STRING, probability DOUBLE, ts TIMESTAMP"

    def batch(*rows):
        base = dt.datetime(2024, 1, 1)
        data = [("S", "twitter", p, base + dt.timedelta(hours=h)) for h, p in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    batch((0.5, 1.0), (1.5, 0.0))
    stream = streaming.landed_posts(spark, str(tmp_path / "in"), schema, format="parquet")

    def run():
        query = (
            streaming.lookback_metrics(stream, hours=2, every="2 hours")
            .writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start(str(tmp_path / "out"))
        )
        query.awaitTermination(120)

    run()
    batch((30.0, 0.5))
    run()
    batch((0.7, 1.0))  # far behind the watermark
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["since"].hour, r["until"].hour, r["nb"], r["avg"]) for r in rows] == [(0, 2, 2, 0.5)]
