"""Language of a text: by script, then by stopword vote, or by a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import LETTER_RUN, words

# A language model: texts in, one language code per text out.
LanguageModel = Callable[[Sequence[str]], Sequence[str]]

# Frequent function words per language.
STOPWORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "as", "was", "on", "are", "by", "this"),
    "fr": ("le", "la", "les", "et", "des", "que", "un", "une", "est", "pour", "dans", "qui", "du", "aux", "avec"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "für", "auf", "den", "zu", "von", "sich"),
    "es": ("el", "la", "los", "las", "y", "que", "en", "un", "una", "es", "por", "con", "para", "del", "se"),
    "it": ("il", "lo", "gli", "che", "di", "non", "per", "una", "sono", "con", "della", "nel", "come", "anche", "più"),
    "pt": ("o", "os", "as", "que", "não", "uma", "para", "com", "do", "da", "em", "por", "mais", "dos", "são"),
    "nl": ("de", "het", "een", "en", "van", "niet", "dat", "zijn", "voor", "met", "op", "aan", "ook", "naar", "bij"),
}

# What a text in another script than the Latin one is said to be.
OTHER_SCRIPT = "xx"
# Characters beyond U+024F but for general punctuation, and the micro sign.
UNUSUAL = r"[\u00b5\u0250-\u1fff\u2070-\x{10ffff}]"
# A text without any stopword is English if no more words than this are left beside tickers.
FEW_WORDS = 8
TICKER = r"\$\p{L}+|(?<![\p{L}\p{N}])\p{Lu}{2,5}(?![\p{L}\p{N}])"


def _in(vocabulary: tuple[str, ...]):
    return lambda word: word.isin(*vocabulary)


def _other_script(text: Column) -> Column:
    """Whether most letters are of another script; looked into only where one is."""
    latin = F.length(F.regexp_replace(text, r"\P{IsLatin}+", ""))
    others = F.length(F.regexp_replace(text, r"[\P{L}\p{IsLatin}]+", ""))
    # a character out of the usual Latin ranges; far cheaper to look for than a letter of another script,
    # if its ranges are named: a class of all but the usual ones takes nine times as long
    return F.rlike(text, F.lit(UNUSUAL)) & (others > latin)


def _terse(text: Column) -> Column:
    """Whether a text has letters, but few words beside tickers."""
    rest = F.regexp_replace(text, TICKER, " ")
    return F.rlike(text, F.lit(r"\p{L}")) & (F.size(F.regexp_extract_all(rest, F.lit(LETTER_RUN), F.lit(0))) <= FEW_WORDS)


def detect_language(text: Column, tokens: Column | None = None) -> Column:
    """The language of a text; NULL when it stays unclear.

    A text mostly in another script is ``OTHER_SCRIPT``. Of others, the language
    with most stopwords counts, the first listed on a tie. Without any stopword,
    a headline or post of few words beside tickers is taken for English, in
    which stopwords are the first thing to go; a longer one is unclear.

    ``tokens`` are the text's lower-case words, if they are there already.

    Works within the row: no explode, no shuffle. The words found are bound to a
    lambda's variable, so that they are found once however often the optimizer
    repeats the parts of an expression it pushes through a projection.
    """
    any_language = tuple(sorted(set().union(*STOPWORDS.values())))
    found = F.filter(words(text) if tokens is None else tokens, _in(any_language))

    def winner(bound: Column) -> Column:
        ballots = []
        for place, (lang, vocabulary) in enumerate(STOPWORDS.items()):
            votes = F.size(F.filter(bound, _in(vocabulary)))
            ballots.append(F.struct(votes.alias("n"), F.lit(-place).alias("rank"), F.lit(lang).alias("lang")))
        most = F.array_max(F.array(*ballots))["lang"]
        return F.when(F.size(bound) > 0, most).otherwise(F.when(_terse(text), F.lit("en")))

    voted = F.get(F.transform(F.array(found), winner), F.lit(0))
    return F.when(_other_script(text), F.lit(OTHER_SCRIPT)).otherwise(voted)


def model_language(load_model: Callable[[], LanguageModel]) -> Callable[[Column], Column]:
    """A model's answer per text, in Arrow batches; it is loaded once per task.

    The model takes a list of texts and returns a list of language codes.
    """

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()), dtype="object")

    return answer


def with_language(
    df: DataFrame,
    text: str,
    out: str = "lang",
    load_model: Callable[[], LanguageModel] | None = None,
    by: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add the language of ``text``: by ``by``, a learned table for one, else by the model if there is one.

    A language that ``df`` knows already, in column ``out``, stands.
    """
    by = by or (model_language(load_model) if load_model else detect_language)
    found = by(F.col(text))
    return df.withColumn(out, F.coalesce(F.col(out), found) if out in df.columns else found)
