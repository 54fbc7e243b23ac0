"""Model scoring: posts without a text, truncation, batches and resources."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

from murmur.operators import scoring


def counting_model(seen):
    """Scores by letters; notes nothing that is not a text."""

    def load():
        def score(texts):
            assert all(isinstance(t, str) for t in texts)
            return [[t.count("e") / 10, 0.0, t.count("a") / 10] for t in texts]

        return score

    return load


def test_posts_without_a_text_stay(spark):
    rows = [(1, "a"), (2, None), (3, "e"), (4, None), (5, "a"), (6, "")]
    posts = spark.createDataFrame(rows, "seq int, text string").repartition(3)
    got = {r["seq"]: r["probability"] for r in scoring.score_posts_batch(posts, counting_model([])).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[2] is None and got[4] is None
    assert got[1] == got[5] > 0 > got[3] and got[6] == 0
    alone = scoring.score_posts_batch(posts.where("text is null"), counting_model([])).collect()
    assert [r["probability"] for r in alone] == [None, None]


@pytest.mark.parametrize("most", [0, 1, 3, 50])
def test_truncated(spark, most):
    rng = random.Random(most)
    bits = ["word", "$TSLA", "12.5", " ", "  ", "!", "é", "don't", "\n", "a-b"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 70))) for _ in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select("text", scoring.truncated(frame["text"], most).alias("cut")).collect():
        tokens = [m.end() for m in re.finditer(r"[^\W_]+|[^\w\s]|_", r["text"])]
        whole = r["text"][: tokens[most - 1]] if 0 < most <= len(tokens) else r["text"][: tokens[-1]] if tokens and most else ""
        assert r["cut"] == whole


def test_the_model_gets_the_tokens_asked_for(spark):
    posts = spark.createDataFrame([(1, "a e e e"), (2, "a a e e")], "seq int, text string")
    got = {r["seq"]: r["probability"] for r in scoring.score_posts_batch(posts, counting_model([]), most_tokens=1).collect()}
    assert got[1] == got[2] > 0


def test_scores_are_the_same_in_any_batch_order(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("aeio ") for _ in range(rng.randint(0, 60)))) for i in range(500)]
    texts = spark.createDataFrame(rows, "seq int, text string").repartition(3)
    score = lambda **o: sorted((r["seq"], tuple(r["logits"])) for r in scoring.score_texts(texts, counting_model([]), "seq", **o).collect())
    plain = score()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert score() == score(by_length=True) == score(by_length=True, tasks=5) == plain
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_stage_gets_its_resources(spark, monkeypatch):
    given = []
    cls = type(spark.range(1))
    real = cls.mapInPandas
    monkeypatch.setattr(cls, "mapInPandas", lambda self, f, schema, barrier=False, profile=None: given.append(profile) or real(self, f, schema))
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1)).build
    posts = spark.createDataFrame([(1, "a")], "seq int, text string")
    assert scoring.score_posts_batch(posts, counting_model([]), profile=profile).count() == 1
    assert given == [profile]
