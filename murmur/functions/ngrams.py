"""A language identifier that is learned: character trigrams and smoothed log-likelihoods."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.language import model_language

# Labelled rows that a model is learned from, at most, taken by a hash of the text.
MOST_LABELLED = 200_000
# Trigrams that a model keeps, the most frequent ones.
MOST_GRAMS = 50_000
# Characters that are scored at a time.
BLOCK_CHARS = 1 << 20


def letters(text: Column) -> Column:
    """The lower-case words of a text, one space before, between and behind them; a space alone without words."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"\P{L}+", " ")


def trigrams(text: Column) -> Column:
    return F.regexp_extract_all(letters(text), F.lit("(?=(...))"), F.lit(1))


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", most_grams: int = MOST_GRAMS) -> DataFrame:
    """The model as a table: (lang, gram, weight), learned from rows with a language.

    ``weight`` is the log-likelihood of the trigram in the language with one
    added to every count, over the ``most_grams`` trigrams that are most frequent
    in all languages together; the null gram stands for any other. The table has
    one row a language and trigram at most, whatever the texts: write it once and
    read it for every job. A table without labelled texts gives an empty model.
    """
    labelled = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    n = labelled.count()
    if n > MOST_LABELLED:
        labelled = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * MOST_LABELLED / n))
    # trigrams of a text are counted where they are; only counts are shuffled
    counts = labelled.select("lang", F.explode(trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    often = counts.groupBy("gram").agg(F.sum("n").alias("often"))
    kept = often.orderBy(F.desc("often"), "gram").limit(most_grams)  # the top of each partition goes on, no more
    known = counts.join(F.broadcast(kept.select("gram")), "gram")
    totals = known.groupBy("lang").agg(F.sum("n").alias("total"))
    size = kept.agg(F.count(F.lit(1)).alias("size"))
    totals = totals.crossJoin(F.broadcast(size))  # one row beside a row a language
    weight = lambda n: F.log((n + 1) / (F.col("total") + F.col("size") + 1))
    seen = known.join(F.broadcast(totals), "lang").select("lang", "gram", weight(F.col("n")).alias("weight"))
    unseen = totals.select("lang", F.lit(None).cast("string").alias("gram"), weight(F.lit(0)).alias("weight"))
    return seen.unionByName(unseen)


class Identifier:
    """The languages of texts, as ``letters`` leaves them, by a learned table."""

    def __init__(self, rows: Sequence[tuple[str, str | None, float]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        grams = sorted({r[1] for r in rows if r[1] is not None})
        place, at = {g: i for i, g in enumerate(grams)}, {lang: i for i, lang in enumerate(self.langs)}
        self.weights = np.zeros((len(grams) + 1, len(self.langs)))
        for lang, gram, weight in rows:
            if gram is None:
                self.weights[:, at[lang]] = weight
        for lang, gram, weight in rows:
            if gram is not None:
                self.weights[place[gram], at[lang]] = weight
        codes = np.array([_code(*map(ord, g)) for g in grams], np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.weights[:-1] = self.weights[:-1][order]

    def __call__(self, texts: Sequence[str]) -> list[str | None]:
        out: list[str | None] = []
        for text in texts:
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            score, n = np.zeros(len(self.langs)), len(chars) - 2
            for low in range(0, n if len(self.codes) else 0, BLOCK_CHARS):
                part = chars[low : low + BLOCK_CHARS + 2]
                grams, times = np.unique(_code(part[:-2], part[1:-1], part[2:]), return_counts=True)
                at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
                at[self.codes[at] != grams] = len(self.codes)
                score += times @ self.weights[at]
            out.append(self.langs[int(np.argmax(score))] if n > 0 and len(self.codes) else None)
        return out


def _code(a, b, c):
    return (a << 42) | (b << 21) | c


def learned_language(model: DataFrame) -> Callable[[Column], Column]:
    """The language of a text by the model in a table, to be given to ``with_language``.

    The table's rows, at most ``MOST_GRAMS`` and one a language, go to the tasks.
    A text without letters, or any text under an empty model, has no language. A
    text is scored whole, whatever its length, and a tie goes to the language
    that is first in order.
    """
    rows = [tuple(r) for r in model.select("lang", "gram", "weight").collect()]
    answer = model_language(lambda: Identifier(rows))

    def found(text: Column) -> Column:
        return answer(letters(text))

    return found
