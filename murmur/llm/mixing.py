"""Mixing sources to target weights by fitting budgets with subset sums.

A source's target is met by whole rounds of all its documents and a rest. For
the rest, documents are counted by exact length: of every length the share that
the rest asks for, then whole documents while the gap is wide, then a bounded
knapsack over all the counts that are left. Where that doesn't meet the rest to
the word, part of the shares is given back and the knapsack widened, until it
does or, for rests of up to ``WHOLE_WORDS`` words, it has chosen among all
documents: then no choice comes nearer. Which documents of a length are taken
follows from a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.arrow import staged
from murmur.session import fits_broadcast

WEIGHTS = (5.0, 2.0, 1.0)
MOST_ROUNDS = 3
#: Widest gap, in words, that is left to the knapsack where shorter documents can narrow it.
KNAPSACK_WORDS = 1 << 15
#: Widest knapsack, in words, that given-back shares may lead to.
WHOLE_WORDS = 1 << 22
#: Lots of documents between two that keep their reachable sums; those between are found again on the way back.
KEPT_SUMS = 64
#: Seeded buckets within a length; only the bucket in which a count ends is sorted.
BUCKETS = 1024

_TAKES = "source string, size long, take long"


def n_words(text: Column) -> Column:
    """Runs of bytes other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each size to take, at most ``counts``, for a sum near ``budget``."""
    goal = int(round(budget))
    total = int((sizes * counts).sum())
    if goal <= 0 or total == 0:
        return np.zeros(len(sizes), np.int64)
    if goal >= total:
        return counts.copy()
    # The share of every length, in whole documents; Python's integers do not overflow.
    take = np.array([int(c) * goal // total for c in counts], np.int64)
    gap = goal - int((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable"):  # long ones first, so that short ones are left for the end
        if gap <= KNAPSACK_WORDS:
            break
        more = min(int(counts[i] - take[i]), (gap - KNAPSACK_WORDS // 2) // int(sizes[i]))
        take[i] += max(0, more)
        gap = goal - int((sizes * take).sum())
    best, given = take + _knapsack(sizes, counts - take, gap), 1
    while take.any():
        miss = abs(goal - int((sizes * best).sum()))
        back = np.minimum(take, given)
        gap += int((sizes * back).sum())
        if miss == 0 or gap > WHOLE_WORDS:
            break
        take, given = take - back, given * 4
        other = take + _knapsack(sizes, counts - take, gap)
        if abs(goal - int((sizes * other).sum())) < miss:
            best = other
    return best


def _knapsack(sizes: np.ndarray, counts: np.ndarray, gap: int) -> np.ndarray:
    """A choice whose sum is as near to ``gap`` as any: sums as bits of one integer.

    Each length enters in lots of 1, 2, 4, ... documents. The bits before every
    ``KEPT_SUMS``-th lot are kept; those between are found anew to walk back.
    """
    over = gap + min(gap, int(sizes.max()))  # a sum farther beyond is never the nearest
    lots, kept, bits, mask = [], [], 1, (1 << over + 1) - 1
    added = lambda bits, lot: bits | (bits << lot[1] * int(sizes[lot[0]])) & mask
    for i in np.argsort(sizes, kind="stable"):
        left, lot = min(int(counts[i]), over // int(sizes[i])), 1
        while left > 0:
            if len(lots) % KEPT_SUMS == 0:
                kept.append(bits)
            lots.append((i, min(lot, left)))
            bits = added(bits, lots[-1])
            left, lot = left - lots[-1][1], lot * 2
        if bits >> gap & 1:
            break
    below = (bits & ((1 << gap + 1) - 1)).bit_length() - 1
    above = bits >> gap + 1
    at = below
    if above:
        beyond = gap + 1 + (above & -above).bit_length() - 1
        if beyond - gap < gap - below:
            at = beyond
    take = np.zeros(len(sizes), np.int64)
    for first in range((len(lots) - 1) // KEPT_SUMS * KEPT_SUMS if lots else -1, -1, -KEPT_SUMS):
        some = lots[first : first + KEPT_SUMS]
        reach = [kept[first // KEPT_SUMS]]
        for lot in some[:-1]:
            reach.append(added(reach[-1], lot))
        for (i, n), before in zip(reversed(some), reversed(reach)):
            if not before >> at & 1:
                take[i] += n
                at -= n * int(sizes[i])
    return take


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_ROUNDS) -> DataFrame:
    """(source, source_size, target) for (source, source_size): words that each source is to give, of all there are.

    Sources in code-point order, null last, take the weights in turn. A target
    above ``most`` times its source's size stops there, and the excess is shared
    among the others by weight, until none is above.

    The table stays distributed. Its order comes from ranges, whose sizes, one
    row a partition, are all that the driver sees; a round of sharing is one
    aggregate, and a source once above stays so, as what the others share grows.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "sources")
    before, starts = 0, []
    for row in ranged.groupBy("part").count().orderBy("part").collect():
        starts.append((row["part"], before))
        before += row["count"]
    if not starts:
        return sizes.withColumn("target", F.lit(0.0))
    starts = sizes.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    rows = staged(ranged.join(F.broadcast(starts), "part").select("source", "source_size", weight.alias("weight")), "weights")
    cap = F.lit(float(most)) * F.col("source_size").cast("double")
    rest, whole = rows.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    total, above = rest, F.lit(False)
    while whole:
        share = F.lit(rest) * F.col("weight") / F.lit(whole)
        over = above | (share > cap)  # a few rounds, as each one's excess is shared at once
        held, free, n = rows.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over & ~above, 1))).first()
        if n == 0:
            return rows.select("source", "source_size", F.when(above, cap).otherwise(share).alias("target"))
        above, rest, whole = over, total - held, free
    return rows.select("source", "source_size", cap.alias("target"))


def mix(
    docs: DataFrame, size: Column, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_ROUNDS, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """How often each document enters the mix.

    Returns every row of ``docs`` as (doc_id, size, source_size, target, taken):
    taken is a multiple of size, at most ``most`` times it. Documents of size 0
    take nothing. A null source is one of its own, the last. Equal rows are
    documents of their own: ties within a length are settled by a seeded hash
    of the doc_id and then by the row's place. The same input and seed give the
    same mix. The lengths of one source are a small table; sources and documents
    stay distributed, also those of one length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    rows = rows.withColumn("bucket", F.pmod(hashed, F.lit(BUCKETS)).cast("int")).withColumn("hashed", hashed)
    rows = staged(rows, "sizes")

    filled = rows.where("size > 0").groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    filled = staged(filled, "lengths")
    counts = filled.groupBy("source", "size").agg(F.sum("n").alias("n"))
    plan = staged(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    plan = plan.withColumnRenamed("source", "_source")
    small = fits_broadcast(plan)
    plan = F.broadcast(plan) if small else plan
    counts = counts.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def takes(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        sizes, n = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        more = fit(sizes, n, target - target // total * total)
        return pd.DataFrame({"source": None if pd.isna(key[0]) else key[0], "size": sizes, "take": more})

    take = staged(counts.groupBy("source").applyInPandas(takes, _TAKES), "takes").where("take > 0")
    # Where each count ends: whole buckets before, part of one, none after.
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket"))
    fill = filled.withColumn("before", upto - F.col("n"))
    take = take.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "take")
    ends = fill.join(take, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    ends = ends.where("before < take").select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("bucket").alias("_bucket"),
        F.least("n", F.col("take") - F.col("before")).alias("quota"), "n",
    )
    met = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("bucket") == F.col("_bucket"))
    rows = rows.join(ends, met, "left").drop("_source", "_size", "_bucket")
    sure = rows.where("quota is null or quota = n").withColumn("extra", F.col("quota").isNotNull())
    order = Window.partitionBy("source", "size", "bucket").orderBy("hashed", "doc_id")
    part = rows.where("quota < n").withColumn("extra", F.row_number().over(order) <= F.col("quota"))
    rows = sure.unionByName(part)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    taken = F.col("size") * (rounds + F.col("extra").cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))

