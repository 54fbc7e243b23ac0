"""The physical plans: what is pushed down, shuffled, broadcast, run in Python."""

import re

import pytest

from murmur.operators import dedup, match
from murmur.plans import views as v
from murmur.plans.queries import QUERIES
from murmur.session import fits_broadcast, shared_dir

PYTHON = {"detect_language_learned", "score_posts_batch", "screener_rows_lenient", "social_sentiment"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_stray_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert ("Python" in text or "Pandas" in text) == (name in PYTHON)


def test_dedup_limits_before_the_shuffle(spark, sf_dir):
    text = plan(dedup.dedup_staged(v.scored_posts(spark, sf_dir)))
    assert text.count("row_number(), 1, Partial") == 4
    assert text.count("row_number(), 1, Final") == 4


def test_metrics_job_reads_posts_once_and_shuffles_no_text(spark, sf_dir):
    text = plan(QUERIES["stock_sentiment_metrics"](spark, sf_dir))
    assert len(re.findall(r"FileScan parquet \[doc_id#\d+L?,text", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 5
    for line in text.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text#" not in line


def test_keyword_match_stays_in_generated_code(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(QUERIES["keyword_match_multi"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert re.search(r"\*\(\d+\) BroadcastHashJoin", text)
    assert "exists(" not in text and "Exchange hashpartitioning" not in text


def test_large_universe_is_not_broadcast_by_hand(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        documents = v.table(spark, sf_dir, "documents")
        found = match.keyword_match(documents, v.keywords(spark), max_broadcast_rows=0)
        assert "Broadcast" not in plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_news_is_summed_before_it_meets_the_sessions(spark, sf_dir):
    text = plan(QUERIES["news_sessions"](spark, sf_dir))
    join = re.search(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) \[ticker#\d+, day#\d+\]", text)
    assert join
    assert "partial_sum(score" in text[join.end() :] or "partial_count" in text[join.end() :]


def test_time_window_and_removed_bodies_reach_the_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from murmur.sources.posts import posts_in_window

    events = v.table(spark, sf_dir, "events")
    text = plan(posts_in_window(events, v.now(), 6, body="event_type").select("event_id"))
    pushed = text[text.index("PushedFilters: ") :]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "Not(Equal" in pushed
    narrow = plan(events.where(F.col("value") > 1).select("event_id"))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in narrow


def test_empty_texts_are_filtered_at_the_scan(spark, sf_dir):
    from murmur.operators.filters import clean_and_drop_empty

    text = plan(clean_and_drop_empty(v.table(spark, sf_dir, "documents")))
    assert "Not(EqualTo(text,))" in text


def test_fits_broadcast_measures(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 100) as s")
    assert fits_broadcast(df)
    assert not fits_broadcast(df, max_rows=99)
    assert not fits_broadcast(df, max_bytes=9_000)


class _Clustered:
    """A session whose cluster names a shared folder."""

    def __init__(self, spark, **settings):
        self._jvm, self._jsparkSession = spark._jvm, spark._jsparkSession
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: settings.get(name, default))})


def test_shared_dir_is_the_clusters(spark, tmp_path):
    warehouse = {"spark.sql.warehouse.dir": f"file://{tmp_path}/warehouse"}
    cluster = _Clustered(spark, **warehouse, **{"spark.checkpoint.dir": f"file://{tmp_path}/shared/"})
    a, b = shared_dir(cluster, "x"), shared_dir(cluster, "x")
    assert a.startswith("file:") and f"{tmp_path}/shared/x-" in a and a != b
    assert f"{tmp_path}/warehouse/_work/x-" in shared_dir(_Clustered(spark, **warehouse), "x")


def test_texts_stay_out_of_the_fold(spark, sf_dir):
    """An exchange of the staged fold never carries a text beside its post."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tree = QUERIES["dedup_staged"](spark, sf_dir)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    outputs = []

    def walk(node):
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            outputs.append(set(re.findall(r"(\w+)#", node.output().toString())))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(tree)
    assert any({"stock", "_digest"} <= names for names in outputs)
    assert not any({"text", "_digest", "stock"} <= names for names in outputs)


def test_no_sorted_aggregate_of_texts(spark, sf_dir):
    assert "SortAggregate" not in plan(QUERIES["social_sentiment"](spark, sf_dir))


def test_cap_input_shuffles_no_text(spark, sf_dir):
    """Only the start of a body is asked for, and times and ties are read back from the shared folder."""
    heads = v.comments(spark, sf_dir, start=10)
    plan = heads._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Join Inner")[1]
    assert "substring(text" in below
    final = QUERIES["cap_input"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in final and "documents" not in final


def test_news_vs_return_scores_a_text_once(spark, sf_dir):
    """Five tickers share the headlines; words are looked for in distinct texts, and no window holds a text."""
    rows = QUERIES["news_vs_return"](spark, sf_dir)
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    lines = text.splitlines()
    generates = [n for n, line in enumerate(lines) if "Generate explode" in line and "regexp_extract_all" in line]
    assert len(generates) == 1 and any("Aggregate [_digest" in line for line in lines[generates[0] :])
    for line in lines:
        if "Window [row_number()" in line:
            assert "headline" not in line
    below = [line for line in lines[generates[0] :] if "Window [" in line]
    assert not below, "texts are de-duplicated over all tickers"
