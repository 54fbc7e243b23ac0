"""The learned language identifier: held-out accuracy, and its scores against plain counts."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import murmur.functions.ngrams as ngrams
from murmur.functions.language import with_language

ROWS = [
    ("en", "the cat sat on the mat and the dog"), ("en", "that this with those"), ("de", "der hund und die katze"),
    ("de", "nicht das über straße"), ("fr", "le chat et le chien"), ("xx", None), (None, "the unlabelled"), ("en", ""), ("en", "12 !"),
]


def grams_of(text):
    padded = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    padded = " ".join(padded.split())
    padded = f" {padded} " if padded else " "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


@pytest.mark.parametrize("most", [50_000, 20])
def test_weights_and_answers_against_plain_counts(spark, most):
    table = spark.createDataFrame(ROWS, "lang string, text string")
    model = ngrams.learn(table, most_grams=most)
    counts = defaultdict(Counter)
    for lang, text in ROWS:
        if lang and text is not None:
            counts[lang].update(grams_of(text))
    every = sum(counts.values(), Counter())
    kept = {g for g, _ in sorted(every.items(), key=lambda x: (-x[1], x[0]))[:most]}
    want, unseen = {}, {}
    for lang, c in counts.items():
        total = sum(n for g, n in c.items() if g in kept)
        if total:
            unseen[lang] = math.log(1 / (total + len(kept) + 1))
            want |= {(lang, g): math.log((n + 1) / (total + len(kept) + 1)) for g, n in c.items() if g in kept}
    got = {(r["lang"], r["gram"]): r["weight"] for r in model.collect()}
    assert got == pytest.approx(want | {(lang, None): w for lang, w in unseen.items()})

    rng = random.Random(1)
    words = [w for _, t in ROWS for w in (t or "").split()] + ["über", "Straße", "日本", "a"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in with_language(rows, "text", by=ngrams.learned_language(model)).collect():
        grams = grams_of(texts[r["id"]])
        if not grams:
            assert r["lang"] is None
            continue
        score = {lang: sum(want.get((lang, g), unseen[lang]) for g in grams) for lang in unseen}
        assert score[r["lang"]] == pytest.approx(max(score.values()), abs=1e-9)


def test_no_letters_no_model_and_long_texts(spark, monkeypatch):
    table = spark.createDataFrame(ROWS, "lang string, text string")
    by = ngrams.learned_language(ngrams.learn(table))
    monkeypatch.setattr(ngrams, "BLOCK_CHARS", 7)
    texts = spark.createDataFrame([("a", None), ("b", ""), ("c", "12 $!"), ("d", "the cat and the dog " * 500), ("e", "und die katze")], "id string, text string")
    assert {r["id"]: r["lang"] for r in with_language(texts, "text", by=by).collect()} == {"a": None, "b": None, "c": None, "d": "en", "e": "de"}
    nothing = ngrams.learned_language(ngrams.learn(table.limit(0)))
    assert {r["lang"] for r in with_language(texts, "text", by=nothing).collect()} == {None}
    given = with_language(texts.withColumn("lang", F.when(F.col("id") == "e", "nl")), "text", by=by)
    assert {r["id"]: r["lang"] for r in given.collect()}["e"] == "nl"


def test_a_stored_model_says_the_same(spark, tmp_path):
    model = ngrams.learn(spark.createDataFrame(ROWS, "lang string, text string"))
    model.write.parquet(f"{tmp_path}/model")
    stored = ngrams.learned_language(spark.read.parquet(f"{tmp_path}/model"))
    texts = spark.createDataFrame([(t,) for _, t in ROWS], "text string")
    say = lambda by: sorted((str(r["text"]), str(r["lang"])) for r in with_language(texts, "text", by=by).collect())
    assert say(stored) == say(ngrams.learned_language(model))


def test_held_out_accuracy(spark):
    """Texts of the given table by a model that has not seen them."""
    from murmur.plans.queries import QUERIES

    rows = QUERIES["detect_language_learned"](spark, "/root/testdata/sf0.01").where("held_out and lang is not null").collect()
    assert len(rows) > 150
    assert sum(r["lang"] == r["found"] for r in rows) >= 0.97 * len(rows)
