"""The rules of the lexicon score against a plain loop over words."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from murmur.operators.valence import Modifiers, rule_score

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "gain": 0.2, "slump": -0.1, "not": -4.0, "very": 3.0}
RULES = Modifiers()


def loop_score(text):
    words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", text or "")
    capitals = [w == w.upper() and w != w.lower() for w in words]
    mixed = any(capitals) and not all(capitals)
    turn = next((i for i, w in enumerate(words) if w.lower() == "but"), None)
    total = 0.0
    for i, word in enumerate(words):
        low = word.lower()
        if low not in LEXICON or low in RULES.all:
            continue
        v = LEXICON[low]
        sign = lambda x: (x > 0) - (x < 0)
        if mixed and capitals[i]:
            v += 0.733 * sign(v)
        for d in (1, 2, 3):
            if i - d < 0:
                break
            w = words[i - d].lower()
            if w in RULES.negations or w.endswith("n't"):
                v *= -0.74
            elif w in RULES.stronger or w in RULES.weaker:
                degree = (0.293 if w in RULES.stronger else -0.293) + (0.733 if mixed and capitals[i - d] else 0)
                v += sign(v) * degree * (1, 0.95, 0.9)[d - 1]
        if turn is not None and i != turn:
            v *= 0.5 if i < turn else 1.5
        total += v
    text = text or ""
    asks = text.count("?")
    marks = 0.292 * min(text.count("!"), 4) + (0.96 if asks > 3 else 0.18 * asks if asks > 1 else 0)
    total += marks * ((total > 0) - (total < 0))
    return total / math.sqrt(total * total + 15)


def test_rules_against_a_loop(spark):
    rng = random.Random(6)
    bits = [*LEXICON, "GOOD", "Bad", "VERY", "Hardly", "so", "isn't", "DON'T", "never", "but", "stock", "é", "!", "?", "!!", "12", "market"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += [None, "", "!!!", "very", "but", "GOOD", "GOOD BAD", "good " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, headline string").repartition(3)
    entries = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    got = {r["id"]: r["compound"] for r in rule_score(rows, entries, keys=["id"]).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(loop_score(text), abs=1e-12), text


def test_known_headlines(spark):
    texts = ["profit is good", "profit is not good", "profit is very good", "profit is good!", "profit is good but margins are bad", "profit is GOOD"]
    entries = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, headline string")
    plain, negated, very, shout, contrast, loud = [r["compound"] for r in rule_score(rows, entries, keys=["id"]).orderBy("id").collect()]
    assert negated < 0 < plain < shout < very < loud and contrast < 0


def test_no_python_and_one_shuffle_at_most(spark):
    entries = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("not good").alias("headline"))
    plan = rule_score(rows, entries, keys=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in plan


def test_marks_are_counted_once_a_text(spark):
    """Above the explode they would be counted in the whole text for each of its words."""
    entries = spark.createDataFrame(list(LEXICON.items()), "token string, valence double")
    rows = spark.range(10).select("id", F.concat(F.col("id").cast("string"), F.lit(" not good!")).alias("headline"))
    plan = rule_score(rows, entries, keys=["id"])._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode")
    assert "headline" not in above and "_text" not in above and "replace(" not in above
    assert "replace(" in below
