"""Scoring of posts and headlines."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.numbers import net_sentiment
from murmur.functions.text import text_digest, words
from murmur.operators.words import join_words, spread_join

# A model: texts in, one row of logits per text out (negative, neutral, positive).
Model = Callable[[Sequence[str]], np.ndarray]

# Normalisation constant of the lexicon score (Hutto and Gilbert 2014).
COMPOUND_ALPHA = 15.0



def truncated(text: Column, most_tokens: int) -> Column:
    """The text up to the end of its ``most_tokens``-th token; a token is a run of letters and numbers or one other mark."""
    # possessive, so that nothing is tried twice; a run of letters and numbers is never cut
    return F.regexp_extract(text, rf"^(?:\s*+(?:[\p{{L}}\p{{N}}]++|[^\p{{L}}\p{{N}}\s])){{0,{most_tokens}}}+", 0)


def score_texts(
    texts: DataFrame,
    load_model: Callable[[], Model],
    key: str,
    text: str = "text",
    tasks: int | None = None,
    by_length: bool = False,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``key`` and ``logits``, in Arrow batches; the model is loaded once per task.

    The batch length is the session's ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    Shuffle partitions are sized by bytes, which is few tasks for a slow model
    and short texts: ``tasks`` spreads the texts evenly over that many.
    ``by_length`` sorts each task's texts by length, so that a batch holds texts
    of about one length and a model that pads them wastes little. ``profile`` is
    what a task of this stage needs, such as a share of an accelerator; other
    stages keep the session's resources.
    """
    if tasks:
        texts = texts.repartition(tasks)
    if by_length:
        texts = texts.sortWithinPartitions(F.length(text))
    schema = T.StructType(
        [T.StructField(key, texts.schema[key].dataType), T.StructField("logits", T.ArrayType(T.FloatType()))]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            if batch.empty:
                continue
            model = model or load_model()
            logits = np.asarray(model(batch[text].tolist()), dtype="float32")
            yield pd.DataFrame({key: batch[key], "logits": list(logits)})

    return texts.select(key, text).mapInPandas(score, schema, profile=profile)


def score_by_digest(
    posts: DataFrame,
    texts: DataFrame,
    load_model: Callable[[], Model],
    digest: str = "digest",
    text: str = "text",
    tasks: int | None = None,
    most_tokens: int | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add ``probability`` in [-1, 1] to posts that carry a digest for their text.

    ``texts`` has the digests with their texts, repeats allowed. Copies of a
    text are merged by hash before the shuffle, so each text moves once and is
    scored once, and only if a post still needs it.
    """
    once = texts.select(digest, text).distinct()  # a digest stands for one text
    needed = once.join(posts.select(digest).distinct(), digest, "left_semi")
    if most_tokens is not None:
        needed = needed.withColumn(text, truncated(F.col(text), most_tokens))
    scored = score_texts(needed, load_model, digest, text, tasks, by_length=True, profile=profile)
    scores = scored.select(digest, net_sentiment(F.col("logits")).alias("probability"))
    return spread_join(posts, scores, digest)


def score_posts_batch(
    posts: DataFrame, load_model: Callable[[], Model], text: str = "text", tasks: int | None = None, most_tokens: int | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add ``probability`` in [-1, 1], scoring each distinct text once.

    A post without a text stays, with a NULL probability; the model never sees
    it. ``most_tokens`` cuts what the model gets, see ``truncated``.
    """
    given = F.col(text) if most_tokens is None else truncated(F.col(text), most_tokens)
    marked = posts.withColumn("_digest", text_digest(given))
    once = posts.select(given.alias(text)).where(F.col(text).isNotNull()).distinct().withColumn("_digest", text_digest(F.col(text)))
    scored = score_texts(once, load_model, "_digest", text, tasks, by_length=True, profile=profile)
    scores = scored.select("_digest", net_sentiment(F.col("logits")).alias("probability"))
    return spread_join(marked, scores, "_digest", "left").drop("_digest").select(*posts.columns, "probability")


def lexicon_score(
    news: DataFrame, lexicon: DataFrame, *, keys: list[str], text: str = "headline", tokens: str | None = None
) -> DataFrame:
    """``keys`` and ``compound`` in [-1, 1]: the valence of the words, normalised.

    ``tokens`` names a column with the text's lower-case words, if there is one.

    ``lexicon`` has ``token`` and ``valence``; ``keys`` identify a text. All
    words of a text are in one task, so the sum is complete, but for merging,
    before the shuffle, which carries the keys and one number per text. Every
    text gets an empty word of valence 0 besides: the join can then be inner,
    which leaves out most words early, and still keep every text.
    """
    nothing = lexicon.sparkSession.createDataFrame([("", 0.0)], "token STRING, valence DOUBLE")
    entries = lexicon.select(F.col("token").alias("_entry"), F.col("valence").cast("double").alias("valence"))
    found = F.coalesce(F.col(tokens) if tokens else words(F.col(text)), F.array().cast("array<string>"))
    tokens = news.select(*keys, F.explode_outer(F.array_append(found, F.lit(""))).alias("_word"))
    return (
        join_words(tokens, "_word", entries.union(nothing), "_entry")
        .groupBy(*keys)
        .agg(F.sum("valence").alias("_sum"))
        .withColumn("compound", F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + COMPOUND_ALPHA))
        .drop("_sum")
    )
