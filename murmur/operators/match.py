"""Keyword match: which posts speak of which stock."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import ALNUM_RUN, is_any_hit_bounded, is_first_hit_bounded, text_digest
from murmur.operators.words import spread_join
from murmur.session import MAX_BROADCAST_BYTES

# Parts in which the posts of one text meet its candidates, which move as often.
TEXT_SALTS = 3

# Longest list of earlier keywords that is spelled out in the plan.
UNROLLED = 8



def keyword_rules(universe: DataFrame) -> DataFrame:
    """One row per (stock, keyword): its place, its anchor, the keywords before it.

    A bounded hit leaves every run of letters and numbers in the keyword a
    maximal run of the post, so any run can serve as an equi-join key; the
    longest is the rarest. A keyword without any run is anchored at its first
    character.
    """
    usable = F.filter(F.array_distinct("keywords"), lambda k: k != "")
    lists = universe.select("stock", usable.alias("keywords"))
    listed = lists.select("stock", "keywords", F.posexplode("keywords").alias("place", "keyword"))
    runs = F.regexp_extract_all("keyword", F.lit(ALNUM_RUN), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    return listed.select(
        "stock",
        "place",
        "keyword",
        F.coalesce(longest, F.substr("keyword", F.lit(1), F.lit(1))).alias("anchor"),
        F.slice("keywords", F.lit(1), F.col("place")).alias("earlier"),
    )


class _Shape(NamedTuple):
    """What the plan depends on, read from the rules in one small job."""

    rows: int
    bytes: int
    most_earlier: int
    symbols: list[str]


def _shape(rules: DataFrame) -> _Shape:
    width = F.octet_length(F.concat_ws("", "stock", "keyword", "anchor", F.array_join("earlier", "")))
    row = rules.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(width), F.lit(0)),
        F.coalesce(F.max(F.size("earlier")), F.lit(0)),
        F.collect_set(F.when(~F.col("anchor").rlike(ALNUM_RUN), F.col("anchor"))),
    ).first()
    return _Shape(*row)


def _run_hashes(text: Column, symbols: list[str]) -> Column:
    """Distinct hashes of a text's runs, and of the symbols some keyword is anchored at."""
    pattern = ALNUM_RUN
    if symbols:
        pattern += "|[" + "".join(f"\\x{{{ord(symbol):x}}}" for symbol in sorted(symbols)) + "]"
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda run: F.xxhash64(run)))


def _any_earlier(earlier: Column, most: int, test: Callable[[Column], Column]) -> Column:
    """Whether one of the keywords in ``earlier`` passes.

    Short lists are spelled out: a lambda would take the join out of the
    generated code, and every token of a post would then carry a copy of its
    text to it.
    """
    if most > UNROLLED:
        return F.exists(earlier, test)
    found = F.lit(False)
    for place in range(most):
        found = found | F.coalesce(test(F.get(earlier, F.lit(place))), F.lit(False))
    return found


def keyword_match(
    posts: DataFrame,
    universe: DataFrame,
    *,
    text: str = "text",
    all_occurrences: bool = False,
    max_broadcast_rows: int = 200_000,
) -> DataFrame:
    """Posts joined with the stocks they mention, at most once per stock.

    ``universe`` has ``stock`` and ``keywords``. The result has the posts'
    columns, ``stock`` and ``keyword``, the first listed one that hits.

    A keyword hits when its first occurrence stands alone: no letter or number
    on either side. With ``all_occurrences`` any occurrence may stand alone.

    Posts meet keywords by an equi-join on the hash of a run, then the exact
    test on the text decides. A post has each hash once, so a pair comes up
    once; one that only shares a hash fails the test. "Once per stock" needs
    no second shuffle: a pair is dropped when an earlier keyword of the same
    stock hits too. The rules are broadcast while they are measured to be
    small; beyond that the join runs on (digest of the text, hash) pairs only,
    of which Spark may leave out early what no rule has, and the texts come back
    for the candidates, a text that most posts share in parts.
    """
    rules = keyword_rules(universe)
    shape = _shape(rules)
    rules = rules.withColumn("_anchor", F.xxhash64("anchor"))

    # The hashes are a column before they are exploded, and the explode is an
    # outer one, so that no text is split twice: Catalyst would test the size
    # of an inner one's input apart.
    hashes = _run_hashes(F.col(text), shape.symbols).alias("_hashes")
    run = F.explode_outer("_hashes").alias("_run")
    same = F.col("_run") == F.col("_anchor")
    if shape.rows <= max_broadcast_rows and shape.bytes <= MAX_BROADCAST_BYTES:
        pairs = posts.select("*", hashes).select(*posts.columns, run).join(F.broadcast(rules), same)
    else:
        digest = text_digest(F.col(text))
        runs = posts.select(digest.alias("_digest"), hashes).select("_digest", run)
        # copies of a text give the same candidates; they are few by then, so they are merged here and not before
        candidates = runs.join(rules, same).drop("_run", "_anchor").distinct()
        pairs = spread_join(posts.withColumn("_digest", digest), candidates, "_digest", salts=TEXT_SALTS).drop("_digest")

    def hits(keyword: Column) -> Column:
        test = is_any_hit_bounded if all_occurrences else is_first_hit_bounded
        return test(F.col(text), keyword)

    exact = hits(F.col("keyword"))
    first = ~_any_earlier(F.col("earlier"), shape.most_earlier, hits)
    return pairs.where(exact & first).select(*posts.columns, "stock", "keyword")
