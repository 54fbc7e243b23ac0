"""Text expressions: cleaning, keyword boundaries, raw-post parsing, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.params import NAME_WORDS

# The patterns that cleaning and matching are defined by.
WEB_ADDRESS = r"https?://[a-zA-Z0-9@:%._/+~#=?&;-]*"
WEB_ADDRESS_TO_LINE_END = r"(?d)https?://.*[\r\n]*"
MENTION = r"(?U)@\S+"
ALNUM = r"[\p{L}\p{N}]"
ALNUM_RUN = r"[\p{L}\p{N}]+"
LETTER_RUN = r"\p{L}+"


def clean_post(text: Column) -> Column:
    """Light cleaning of a post before scoring.

    Lower case; a newline swallows the digit after it; web addresses become a
    space; pairs of spaces become one, in a single pass (three give two).
    """
    out = F.lower(text)
    out = F.regexp_replace(out, r"\n\p{Nd}", " ")
    out = F.replace(out, F.lit("\n"), F.lit(" "))
    out = F.regexp_replace(out, WEB_ADDRESS, " ")
    return F.replace(out, F.lit("  "), F.lit(" "))


def clean_headline(text: Column) -> Column:
    """Cut from a web address to the line's end, drop ``#`` and mentions."""
    out = F.regexp_replace(text, WEB_ADDRESS_TO_LINE_END, "")
    out = F.replace(out, F.lit("#"), F.lit(""))
    return F.regexp_replace(out, MENTION, "")


def text_digest(text: Column) -> Column:
    """32 bytes that stand for a text as a shuffle key."""
    return F.unhex(F.sha2(text, 256))


def alnum_runs(text: Column) -> Column:
    """Distinct maximal runs of letters and numbers."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ALNUM_RUN), F.lit(0)))


def words(text: Column) -> Column:
    """Lower-case words, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTER_RUN), F.lit(0))


def is_first_hit_bounded(text: Column, keyword: Column) -> Column:
    """Keyword occurs, and its first occurrence has no letter or number beside it.

    ``\\b`` would not do: ``_`` is a boundary here, and so is ``$``.
    """
    at = F.position(keyword, text)
    left = F.when(at > 1, F.substr(text, at - 1, F.lit(1))).otherwise(F.lit(""))
    right = F.substr(text, at + F.length(keyword), F.lit(1))
    return (at > 0) & ~left.rlike(ALNUM) & ~right.rlike(ALNUM)


def is_any_hit_bounded(text: Column, keyword: Column) -> Column:
    """As above, but any occurrence of the keyword will do.

    The pattern search, which is slow, is left for texts that have the keyword
    and whose first occurrence does not settle it.
    """
    quoted = F.regexp_replace(keyword, r"([^\p{L}\p{N}\s])", r"\\$1")
    alone = F.concat(F.lit(f"(?<!{ALNUM})"), quoted, F.lit(f"(?!{ALNUM})"))
    return is_first_hit_bounded(text, keyword) | (F.contains(text, keyword) & F.regexp_like(text, alone))


def twitter_user(raw: Column) -> Column:
    """First line of a landed Twitter post."""
    return F.get(F.split(raw, "\n", 2), F.lit(0))


def twitter_text(raw: Column) -> Column:
    """Fifth line onwards, joined by spaces; empty when there is none."""
    rest = F.get(F.split(raw, "\n", 5), F.lit(4))
    return F.coalesce(F.replace(rest, F.lit("\n"), F.lit(" ")), F.when(raw.isNotNull(), F.lit("")))


def _stocktwits_line(raw: Column, number: int) -> Column:
    return F.get(F.split(raw, "\n"), F.lit(number))


def _is_tag(line: Column) -> Column:
    return F.contains(line, F.lit("Bullish")) | F.contains(line, F.lit("Bearish"))


def stocktwits_user(raw: Column) -> Column:
    """First line of a landed Stocktwits post."""
    return _stocktwits_line(raw, 0)


def stocktwits_directional(raw: Column) -> Column:
    """The whole second line when it is a Bullish or Bearish tag, else empty."""
    line = _stocktwits_line(raw, 1)
    return F.when(_is_tag(line), line).otherwise(F.lit(""))


def stocktwits_text(raw: Column) -> Column:
    """What follows the third newline of a tagged post, the second of another.

    NULL when the post has too few lines.
    """
    line = _stocktwits_line(raw, 1)
    return F.when(_is_tag(line), F.get(F.split(raw, "\n", 4), F.lit(3))).otherwise(
        F.get(F.split(raw, "\n", 3), F.lit(2))
    )


def company_name(title: Column, remove: tuple[str, ...] = NAME_WORDS) -> Column:
    """Company name without legal forms, commas and one-letter words."""
    out = title
    for word in remove:
        out = F.replace(out, F.lit(word), F.lit(""))
    kept = F.filter(F.split(out, r"(?U)\s+"), lambda w: F.length(w) > 1)
    return F.array_join(kept, " ")


def ticker_keyword(symbol: Column) -> Column:
    """The keyword a stock is searched by: its ticker in capitals."""
    return F.upper(F.trim(symbol))
