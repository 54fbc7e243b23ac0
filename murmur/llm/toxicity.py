"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else is unlabelled, also
rows labelled as clean. With class prior p and logistic loss, the risk is
p R+(positives as 1) + max(0, R-(unlabelled as 0) - p R-(positives as 0)):
what the positives among the unlabelled add to the second term is taken out,
and where a model drives that term below zero, the step goes the other way, so
it cannot gain from calling confirmed texts clean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import batch_of, pieces, staged, strings
from murmur.llm.sampling import least_hashed
from murmur.llm.words import BETWEEN_TERMS, distinct, hash_words

#: Most texts that are learned from, of either kind: those with the least hash.
MOST_POSITIVE, MOST_UNLABELLED = 4_000, 8_000
#: Hashed features: each term, and its first bytes of these numbers.
FEATURES, FIRST_BYTES = 1 << 20, (4, 5, 6)
#: Standard errors by which a feature must be commoner in the positives than in the unlabelled.
LEAST_SIGN = 5.0
MEMBERS, STEPS, RATE, DECAY = 3, 200, 0.05, 1e-4


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct features of each text: runs of letters and digits, A-Z lower-cased, and how they begin."""
    hashes, counts = hash_words(*strings(column), True, BETWEEN_TERMS, FIRST_BYTES)
    return distinct(hashes % np.uint64(FEATURES), counts)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full])
    return out


class Model(NamedTuple):
    """The features that count, their weights, and a bias."""

    used: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self) -> Callable[[pa.Array], np.ndarray]:
        """Scores of a column of texts."""
        weights = np.zeros(FEATURES)
        weights[self.used] = self.weights

        def score(column: pa.Array) -> np.ndarray:
            flat, counts = terms(column)
            return 1 / (1 + np.exp(-np.clip(_sums(weights[flat.astype(np.int64)], counts) + self.bias, -30, 30)))

        return score


NOTHING_KNOWN = Model(np.zeros(0, np.int64), np.zeros(0), -30.0)


def train(features: list[np.ndarray], positive: np.ndarray, prior: float) -> Model:
    """A linear model with the least non-negative risk."""
    n_pos, n_un = max(1, positive.sum()), max(1, (~positive).sum())
    seen = [np.zeros(FEATURES), np.zeros(FEATURES)]
    for found, toxic in zip(features, positive):
        seen[int(toxic)][found] += 1  # features of one text are distinct
    both = (seen[0] + seen[1] + 1) / (n_pos + n_un + 2)
    error = np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_un))
    stands_out = seen[1] / n_pos - seen[0] / n_un > LEAST_SIGN * error
    features = [found[stands_out[found]] for found in features]
    counts = np.array([len(f) for f in features])
    text = np.repeat(np.arange(len(features)), counts)
    used, flat = np.unique(np.concatenate(features) if features else np.zeros(0, np.int64), return_inverse=True)
    w, bias = np.zeros(len(used) + 1), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    w[-1] = bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(_sums(w[flat], counts) + w[-1], -30, 30)))
        # loss as 0 is -log(1 - p), with slope p; as 1 it is -log p, with slope p - 1
        as_clean = -np.log1p(-np.minimum(p, 1 - 1e-12))
        excess = as_clean[~positive].sum() / n_un - prior * as_clean[positive].sum() / n_pos
        slope = np.where(positive, -prior * p / n_pos, p / n_un)
        if excess >= 0:
            slope = slope + np.where(positive, prior * (p - 1) / n_pos, 0)
        else:
            slope = -slope
        grad = np.append(np.bincount(flat, slope[text], len(used)), slope.sum())
        grad[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(used, w[:-1], float(w[-1]))


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are not learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The mean of classifiers trained in tasks of their own on bounded samples.

    ``labels`` has (doc_id, toxic); rows that are held out, and labels that are
    null, teach nothing. Without a confirmed toxic text the model knows no terms
    and scores every text by a prior of 0.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    row = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not row[0] or not row[1]:
        return NOTHING_KNOWN
    prior = row[1] / row[0]
    order = F.xxhash64(F.lit(5), "doc_id")
    positive = least_hashed(known.where("toxic = 1").select("doc_id"), order, "doc_id", MOST_POSITIVE)
    pool = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    pool = least_hashed(pool, order, "doc_id", MOST_UNLABELLED)
    ids = positive.withColumn("positive", F.lit(True)).union(pool.withColumn("positive", F.lit(False)))
    schema = pa.schema([("member", pa.int32()), ("positive", pa.bool_()), ("terms", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            flat, counts = terms(piece.column("text"))
            found = [f.astype(np.uint32).tobytes() for f in np.split(flat, np.cumsum(counts)[:-1])]
            yield batch_of(schema, [piece.column("member"), piece.column("positive"), found])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # bounded by the two limits
    texts = texts.groupBy("doc_id", "positive").agg(F.min("text").alias("text"))  # one text of an id that repeats
    member = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(MEMBERS)).cast("int")
    sample = texts.select(member.alias("member"), "positive", "text")
    sample = sample.mapInArrow(gather, "member int, positive boolean, terms binary")
    left_out = F.explode(F.array(*[F.lit(m) for m in range(MEMBERS)])).alias("model")
    sample = staged(sample, "sample").select(left_out, "*").where("model <> member")

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["positive", "terms"])  # the same sums whatever the order of arrival
        features = [np.frombuffer(t, np.uint32) for t in group["terms"]]
        model = train(features, group["positive"].to_numpy(bool), prior)
        return pd.DataFrame({"used": [model.used.tolist()], "weights": [model.weights.tolist()], "bias": [model.bias]})

    # MEMBERS rows with the few features that stand out
    rows = sample.groupBy("model").applyInPandas(learn, "used array<long>, weights array<double>, bias double").collect()
    if not rows:
        return NOTHING_KNOWN
    mean: dict[int, float] = {}
    for r in sorted(rows, key=lambda r: r["bias"]):
        for feature, weight in zip(r["used"], r["weights"]):
            mean[feature] = mean.get(feature, 0.0) + weight / len(rows)
    used = sorted(mean)
    return Model(np.array(used, np.int64), np.array([mean[f] for f in used]), sum(sorted(r["bias"] for r in rows)) / len(rows))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row by the terms of its whole text.

    A null or empty text is scored by the bias. Rows without a doc_id are scored
    like any other and teach nothing; rows that repeat one are scored each.
    """
    model = fit(docs, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for piece in pieces(batches, "text"):
            p = scores(piece.column("text"))
            yield batch_of(schema, [piece.column("doc_id"), piece.column("held_out"), p, (p >= 0.5).astype(np.int32)])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, that are not predicted to be toxic."""
    model = fit(docs, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for piece in pieces(batches, "text"):
            yield piece.filter(pa.array(scores(piece.column("text")) < 0.5))

    return docs.mapInArrow(judge, docs.schema)
