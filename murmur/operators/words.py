"""Joins of words with word lists, and of rows with what is known of their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.session import fits_broadcast

# Parts in which the rows of one text meet what is known of it.
SALTS = 8


def spread_join(rows: DataFrame, known: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on ``key``; a key that most rows share is joined in ``salts`` parts, for which ``known`` is repeated."""
    others = [name for name in rows.columns if name != key]
    part = F.pmod(F.xxhash64(*others), F.lit(salts)) if others else F.pmod(F.spark_partition_id(), F.lit(salts))
    every = F.explode(F.array(*[F.lit(n) for n in range(salts)])).alias("_part")
    salted = rows.withColumn("_part", part.cast("int"))
    return salted.join(known.select("*", every), [key, "_part"], how).drop("_part")


def join_words(words: DataFrame, word: str, entries: DataFrame, entry: str, broadcast: bool | None = None) -> DataFrame:
    """Inner join on ``word`` equal to ``entry``.

    Texts explode into so many words that the look-up is what the join costs,
    and a look-up by a 64-bit hash takes a fraction of one by a string. The
    words are compared as well, as two inequalities, since an equality would
    become a join key and bring the string look-up back.

    ``entries`` is broadcast if it is proven small, or as ``broadcast`` says.
    """
    hashed = entries.withColumn("_entry_hash", F.xxhash64(entry))
    if fits_broadcast(entries) if broadcast is None else broadcast:
        hashed = F.broadcast(hashed)
    same = (F.col(word) >= F.col(entry)) & (F.col(word) <= F.col(entry))
    return (
        words.withColumn("_word_hash", F.xxhash64(word))
        .join(hashed, (F.col("_word_hash") == F.col("_entry_hash")) & same)
        .drop("_word_hash", "_entry_hash")
    )
