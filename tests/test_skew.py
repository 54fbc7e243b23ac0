"""A key that holds a third of all rows must not reach one task as it is."""

from pyspark.sql import functions as F

from murmur.operators import dedup, scoring, sessions

ROWS, PARTS = 60_000, 8


def shuffled_records(df):
    """Run ``df``; the records each of its shuffles wrote, in plan order."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


def skewed(spark):
    """Posts of which a third share stock, text and user."""
    hot = F.col("id") % 3 == 0
    return spark.range(0, ROWS, 1, PARTS).select(
        F.when(hot, "S").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("stock"),
        F.lit("twitter").alias("source"),
        F.when(hot, "u").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("user"),
        F.when(hot, "copy").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"),
        F.col("id").alias("seq"),
    )


def test_copies_are_dropped_before_the_shuffle(spark):
    posts = dedup.with_source_order(skewed(spark))
    for df in (dedup.dedup_text(posts), dedup.dedup_user(posts)):
        records = shuffled_records(df.select("stock", "seq"))
        assert records == [ROWS * 2 // 3 + PARTS]


def test_staged_dedup_never_shuffles_the_copies(spark):
    posts = dedup.with_source_order(skewed(spark))
    records = shuffled_records(dedup.dedup_staged(posts, with_text=False).select("stock", "seq"))
    assert len(records) == 4
    assert max(records) <= ROWS * 2 // 3 + PARTS


def test_posts_without_a_user_spread(spark):
    posts = dedup.with_source_order(skewed(spark).withColumn("user", F.lit(None).cast("string")))
    kept = dedup.dedup_user(posts).groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in kept.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == ROWS and max(sizes) < ROWS / 2


def test_copies_are_scored_once(spark):
    texts = skewed(spark).select("text").distinct()
    assert shuffled_records(texts) == [ROWS * 2 // 3 + PARTS]
    load = lambda: lambda batch: [[0.0, 0.0, 1.0]] * len(batch)
    assert scoring.score_posts_batch(skewed(spark), load).count() == ROWS


def test_hot_ticker_is_summed_before_the_shuffle(spark):
    news = skewed(spark).select(
        F.when(F.col("stock") == "S", "S").otherwise("other").alias("ticker"),
        (F.lit("2024-01-01 12:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("seq") % 5).cast("int"))).alias("ts"),
        F.lit(0.5).alias("score"),
    )
    days = spark.range(1, 8).select(
        F.explode(F.array(F.lit("S"), F.lit("other"))).alias("ticker"),
        F.date_add(F.lit("2023-12-31").cast("date"), F.col("id").cast("int")).alias("date"),
    )
    scores = sessions.news_sessions(news, sessions.session_gap(days))
    assert max(shuffled_records(scores)) <= 2 * 5 * PARTS
    assert scores.agg(F.sum("nb")).first()[0] == ROWS


def test_lexicon_shuffles_one_number_per_text(spark):
    posts = skewed(spark).select("seq", F.concat("text", F.lit(" good good bad day")).alias("headline"))
    words = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "token STRING, valence DOUBLE")
    scored = scoring.lexicon_score(posts.repartition(PARTS, "headline"), words, keys=["seq"])
    assert shuffled_records(scored) == [ROWS, ROWS]  # the sum, then the test's own repartition


def test_copies_meet_their_score_in_parts(spark):
    """The join of a third of all rows with one score is spread, whatever adaptive execution does."""
    load = lambda: lambda batch: [[0.0, 0.0, 1.0]] * len(batch)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        scored = scoring.score_posts_batch(skewed(spark), load)
        sizes = [r["count"] for r in scored.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == ROWS and max(sizes) < ROWS / 6


def test_cap_in_one_second(spark):
    """All posts in one second: few rows are sorted, and the right ones stay."""
    from murmur.sources import posts as source

    at = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    rows = spark.range(0, ROWS, 1, PARTS).select((F.col("id") * 7919 % 1_000_003).alias("seq"), at.alias("ts"))
    kept = source.cap_posts(rows, limit=25_000)
    assert max(shuffled_records(kept), default=0) <= 1100 * PARTS
    expected = [r["seq"] for r in rows.orderBy("seq").limit(25_000).collect()]
    assert sorted(r["seq"] for r in source.cap_posts(rows, limit=25_000).collect()) == expected


def test_runs_without_a_rule_are_not_shuffled(spark):
    from murmur.operators.match import keyword_match

    posts = skewed(spark).select("seq", F.concat("text", F.lit(" common words here and there GME")).alias("text"))
    rules = spark.createDataFrame([("GME", ["GME"])], "stock STRING, keywords ARRAY<STRING>")
    found = keyword_match(posts, rules, max_broadcast_rows=0)
    runs = shuffled_records(found)
    assert found.count() == ROWS
    assert sum(runs) <= 4 * ROWS  # of each text its digest and the one run; no word that no rule has


def test_a_hot_text_meets_its_rules_in_parts(spark):
    from murmur.operators.match import keyword_match

    posts = skewed(spark).select("seq", F.concat("text", F.lit(" and GME")).alias("text"))
    rules = spark.createDataFrame([("GME", ["GME"])], "stock STRING, keywords ARRAY<STRING>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        found = keyword_match(posts, rules, max_broadcast_rows=0)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == ROWS and max(sizes) < ROWS / 4
