"""Lexicon score by rules: negation, degree words, capitals, contrast and punctuation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.scoring import COMPOUND_ALPHA
from murmur.operators.words import join_words

# A word with its apostrophes.
WORD = r"\p{L}+(?:'\p{L}+)*"

# The published constants (Hutto and Gilbert 2014).
DEGREE = 0.293
CAPITALS = 0.733
NEGATED = -0.74
BY_DISTANCE = (1.0, 0.95, 0.9)
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, FEW_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96

_NEGATION = 9.0  # stands for a negation among the weights of degree words


@dataclass(frozen=True)
class Modifiers:
    """Words that change what follows, in lower case; they carry no valence of their own."""

    negations: tuple[str, ...] = tuple(
        "not never none no nobody nothing nowhere neither nor cannot without rarely seldom despite".split()
    )
    stronger: tuple[str, ...] = tuple(
        """absolutely amazingly completely considerably decidedly deeply enormously entirely especially exceptionally
        extremely fully greatly highly hugely incredibly intensely majorly more most particularly purely quite really
        remarkably so substantially thoroughly totally tremendously unbelievably unusually utterly very""".split()
    )
    weaker: tuple[str, ...] = tuple(
        "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat".split()
    )
    contrast: tuple[str, ...] = ("but",)
    # an ending that negates
    suffix: str = field(default="n't")

    @property
    def all(self) -> tuple[str, ...]:
        return (*self.negations, *self.stronger, *self.weaker)


def _bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in_capitals(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _weight(word: Column, mixed: Column, rules: Modifiers) -> Column:
    """What a word does to the ones after it: the weight of a degree word, or a negation."""
    low = F.lower(word)
    loud = F.when(mixed & _in_capitals(word), CAPITALS).otherwise(0.0)
    return (
        F.when(low.isin(*rules.negations) | F.endswith(low, F.lit(rules.suffix)), F.lit(_NEGATION))
        .when(low.isin(*rules.stronger), F.lit(DEGREE) + loud)
        .when(low.isin(*rules.weaker), F.lit(-DEGREE) + loud)
        .otherwise(F.lit(0.0))
    )


def tokens_in_context(text: Column, rules: Modifiers) -> Column:
    """The words of a text in order, each with what the words around it do to its valence.

    An array of (token, loud, before, side): whether the word stands out in
    capitals, the weights of the three words before it, nearest first, and the
    factor of its side of the first contrast. Whatever a word's valence will be,
    this is all that the rules ask of the rest of the text.
    """

    def located(ws: Column) -> Column:
        loud = F.exists(ws, _in_capitals) & F.exists(ws, lambda w: ~_in_capitals(w))
        turn = F.array_position(F.transform(ws, lambda w: F.lower(w).isin(*rules.contrast)), True)  # from 1; 0 without
        return _bound(F.struct(loud.alias("mixed"), turn.alias("turn")), lambda known: weighed(ws, known))

    def weighed(ws: Column, known: Column) -> Column:
        weights = F.transform(ws, lambda w: _weight(w, known["mixed"], rules))
        return _bound(weights, lambda ks: F.transform(ws, lambda w, i: placed(w, i, ks, known)))

    def placed(word: Column, i: Column, weights: Column, known: Column) -> Column:
        side = (
            F.when((known["turn"] == 0) | (i + 1 == known["turn"]), F.lit(1.0))
            .when(i + 1 < known["turn"], F.lit(BEFORE_CONTRAST))
            .otherwise(F.lit(AFTER_CONTRAST))
        )
        before = [F.coalesce(F.get(weights, i - d), F.lit(0.0)).alias(f"before{d}") for d in (1, 2, 3)]
        loud = (known["mixed"] & _in_capitals(word)).alias("loud")
        return F.struct(F.lower(word).alias("token"), loud, *before, side.alias("side"))

    return _bound(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), located)


def in_context(valence: Column, loud: Column, before: list[Column]) -> Column:
    """A word's valence after capitals, degree words and negations, the nearest word first."""
    out = F.when(loud, valence + F.signum(valence) * CAPITALS).otherwise(valence)
    for weight, share in zip(before, BY_DISTANCE):
        out = F.when(weight == _NEGATION, out * NEGATED).otherwise(out + F.signum(out) * weight * share)
    return out


def emphasis(text: Column) -> Column:
    """What exclamation and question marks add to a score, away from zero."""
    number = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark)))
    shouts = F.least(number("!"), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION
    asks = number("?")
    asks = F.when(asks > FEW_QUESTIONS, MANY_QUESTIONS).when(asks > 1, asks * QUESTION).otherwise(0.0)
    return F.coalesce(shouts + asks, F.lit(0.0))


def rule_score(
    news: DataFrame, lexicon: DataFrame, *, keys: list[str], text: str = "headline", rules: Modifiers = Modifiers()
) -> DataFrame:
    """``keys`` and ``compound`` in [-1, 1]: the valence of the words in their context, normalised.

    A word's valence is raised by its capitals, if others have none; each of the
    three words before it adds or takes by its degree, or negates; words before
    the first contrast count half, those after it one and a half times; marks
    add to the sum away from zero. Idioms, emoticons and "least" are not known.

    ``lexicon`` has ``token`` and ``valence``; entries of ``rules`` are modifiers
    even where the lexicon has them. ``keys`` identify a text. What the rules ask
    of a text is settled within its row, so words meet the lexicon one by one,
    and only the keys and two numbers a text are shuffled. A NULL text scores 0.
    """
    spark = lexicon.sparkSession
    entries = lexicon.where(~F.col("token").isin(*rules.all)).select(F.col("token").alias("_entry"), F.col("valence").cast("double").alias("valence"))
    entries = entries.union(spark.createDataFrame([("", 0.0)], "token STRING, valence DOUBLE"))
    zero = F.lit(0.0)
    nothing = F.struct(
        F.lit("").alias("token"), F.lit(False).alias("loud"), *(zero.alias(f"before{d}") for d in (1, 2, 3)), zero.alias("side")
    )
    found = F.array_append(tokens_in_context(F.col("_text"), rules), nothing)
    # The marks come first: beside the explode they would be counted above it, in the whole text for each of its words.
    marked = news.select(*keys, F.col(text).alias("_text"), emphasis(F.col(text)).alias("_marks"))
    # an outer explode, as the size of an inner one's array would be tested apart and the text be read twice
    words = marked.select(*keys, "_marks", F.explode_outer(found).alias("_w"))
    words = words.select(*keys, "_marks", F.col("_w.token").alias("_word"), "_w.loud", "_w.before1", "_w.before2", "_w.before3", "_w.side")
    value = in_context(F.col("valence"), F.col("loud"), [F.col(f"before{d}") for d in (1, 2, 3)]) * F.col("side")
    met = join_words(words, "_word", entries, "_entry").select(*keys, "_marks", value.alias("_value"))
    total = met.groupBy(*keys).agg(F.sum("_value").alias("_sum"), F.max("_marks").alias("_marks"))
    total = total.withColumn("_sum", F.col("_sum") + F.signum("_sum") * F.col("_marks"))
    return total.select(*keys, (F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + COMPOUND_ALPHA)).alias("compound"))
