"""De-duplication that keeps the first row in a stated order.

All of it is ``row_number() = 1``: Spark turns that into a group limit that
leaves one row per key and map task before the shuffle, so a key that holds a
third of all rows costs no more than any other. ``dropDuplicates`` would not
do, as it does not say which row it keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.text import text_digest
from murmur.params import SOURCES

ARRIVAL = ("ord", "seq")


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by ``order``, which must be a total order."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", first).where(F.col("_first") == 1).drop("_first")


def with_source_order(posts: DataFrame) -> DataFrame:
    """Add ``ord``, the place of the post's source in the arrival order."""
    place = F.lit(None).cast("int")
    for number, source in reversed(list(enumerate(SOURCES))):
        place = F.when(F.col("source") == source, F.lit(number)).otherwise(place)
    return posts.withColumn("ord", place)


def dedup_text(posts: DataFrame, digest: str | None = None, order: tuple = ARRIVAL) -> DataFrame:
    """The first post of each text within a stock.

    Texts are compared by a 32-byte digest, so a text is shuffled only if the
    result is asked for it. ``digest`` names a column that holds it already.
    """
    return keep_first(posts, ["stock", digest or text_digest(F.col("text"))], list(order))


def dedup_headlines(news: DataFrame, order: str = "id", digest: str | None = None) -> DataFrame:
    """The first record of each headline within a ticker.

    Records that share their ``order`` are told apart by their other columns.
    ``digest`` names a column that stands for the headline, if there is one.
    """
    others = F.xxhash64(*[name for name in news.columns if name not in ("headline", digest)])
    return keep_first(news, ["ticker", F.col(digest) if digest else text_digest(F.col("headline"))], [order, others])


def dedup_user(
    posts: DataFrame, null_user: str = "keep", order: tuple = ARRIVAL, waiting: Column | None = None
) -> DataFrame:
    """The first post of each user within a stock.

    ``null_user="keep"`` leaves posts without a user alone: each is a group of
    its own, which also spreads them over the cluster. ``"collapse"`` takes
    them for one and the same user. Posts that are ``waiting`` are left alone.
    """
    if null_user not in ("keep", "collapse"):
        raise ValueError("null_user must be 'keep' or 'collapse'")
    alone = F.lit(False) if waiting is None else waiting
    if null_user == "keep":
        alone = alone | F.col("user").isNull()
    return keep_first(posts, ["stock", "user", *[F.when(alone, F.col(name)) for name in order]], list(order))


def dedup_staged(posts: DataFrame, null_user: str = "keep", digest: str | None = None, *, with_text: bool = True) -> DataFrame:
    """De-duplicate source by source, as posts arrive.

    After the first source, repeated texts go; after each later one, repeated
    texts and then repeated users, over all that has been kept so far. One
    final pass is not the same: a post dropped for its user at one stage no
    longer hides its text at the next.

    All sources go through every stage, so the posts are read once. Those of
    a source still to come wait: in a text pass they only meet their own
    source, where a repeat could never win anyway, and in a user pass nobody.
    The first source's own stage is not run apart, since the second stage's
    text pass starts from the same first rows. ``digest`` is as in
    ``dedup_text``.

    The passes carry digests. With ``with_text`` the texts come back at the end,
    by a join of the distinct texts with the posts that are left; else the
    result has no ``text``.
    """
    marked = posts if digest else posts.withColumn("_digest", text_digest(F.col("text")))
    name = digest or "_digest"
    kept = marked.drop("text")
    for stage in range(1, len(SOURCES)):
        waiting = F.col("ord") > stage
        kept = keep_first(kept, ["stock", name, F.greatest("ord", F.lit(stage))], list(ARRIVAL))
        kept = dedup_user(kept, null_user, waiting=waiting)
    if with_text and "text" in posts.columns:
        texts = marked.select(name, "text").distinct()  # copies are merged by hash before they move
        return kept.join(texts, name, "left").select(posts.columns)
    return kept.drop("_digest")


def dedup_single_pass(posts: DataFrame, null_user: str = "keep") -> DataFrame:
    """Texts, then users, once over all sources."""
    return dedup_user(dedup_text(posts), null_user)
