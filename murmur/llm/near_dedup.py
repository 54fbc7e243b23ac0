"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's signature has 40 slots of 12 bits, cut into 8 chunks of 5 slots.
Two signatures that differ in at most 15 slots have, by the pigeonhole
principle, a chunk with at most one differing slot. So each chunk gives five
keys, one for each slot that may err, left out; all pairs within distance 15
share a key, and at a similarity of 0.8 a pair within any distance shares one
but for 1 case in 43,000.

Documents joined by shared keys form clusters. Within a cluster, similarities
come from the full sets, through the runs that documents share. A cluster that
is too large for a task is cut into blocks: each is solved with a few members of
the whole cluster as pivots, and what is then outside the cluster's main
component meets every block. Only links that join something are passed on, so a
group of thousands of copies costs about as many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.arrow import batch_of, pieces, staged
from murmur.llm.links import components
from murmur.llm.words import column_words, distinct, mix, shingles

CHUNKS, SLOTS, BITS = 8, 5, 12
#: Members and runs of words that a block has, about, and pivots that all blocks of a cluster see.
BLOCK_MEMBERS, BLOCK_RUNS, PIVOTS = 1000, 2_000_000, 4

_SIG = [f"s{i}" for i in range(CHUNKS)]
_LANE = (1 << BITS) - 1
_SEEDS = mix(np.arange(1, CHUNKS * SLOTS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _mins(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Chunk signatures, one row a chunk, of texts that each have a value."""
    at = np.cumsum(counts) - counts
    out = np.zeros((CHUNKS, len(counts)), np.uint64)
    for k in range(CHUNKS * SLOTS):
        least = np.minimum.reduceat((values ^ _SEEDS[k]) * (_SEEDS[k] | np.uint64(1)), at)
        out[k // SLOTS] |= (mix(least) >> np.uint64(64 - BITS)) << np.uint64(BITS * (k % SLOTS))
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, two words that name the set, chunk signatures)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64())]
        + [(s, pa.int64()) for s in _SIG]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words, counts = column_words(piece.column("text"), lower=True)
            values, sizes = distinct(*shingles(words, counts, n))
            full = sizes > 0
            columns = np.zeros((2 + CHUNKS, len(sizes)), np.uint64)
            if full.any():
                at = (np.cumsum(sizes) - sizes)[full]
                columns[0, full] = np.add.reduceat(mix(values + np.uint64(7)), at)
                columns[1, full] = np.bitwise_xor.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)
                columns[2:, full] = _mins(values, sizes[full])
            yield batch_of(schema, [piece.column("doc_id"), sizes, *columns.view(np.int64)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    types = "doc_id long, n_shingles long, set_a long, set_b long, " + ", ".join(f"{s} long" for s in _SIG)
    return rows.mapInArrow(sign, types)


def _keys() -> list[Column]:
    """The key of every chunk without each of its slots."""
    keys = []
    for i, s in enumerate(_SIG):
        for j in range(SLOTS):
            rest = ((1 << BITS * SLOTS) - 1) ^ (_LANE << BITS * j)
            keys.append(F.xxhash64(F.lit(i * SLOTS + j), F.col(s).bitwiseAND(F.lit(rest))))
    return keys


class _Index:
    """Sets of hashes by value, to count what a set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.values, self.starts, self.often = np.unique(flat[order], return_index=True, return_counts=True)

    def similar(self, one: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets similar enough to ``one``."""
        at = np.minimum(np.searchsorted(self.values, one), len(self.values) - 1)
        at = at[self.values[at] == one]
        often = self.often[at]
        ends = np.cumsum(often)
        if not len(ends):
            return np.zeros(0, np.int64)
        shared = np.bincount(self.owner[np.repeat(self.starts[at] - (ends - often), often) + np.arange(ends[-1])], minlength=len(self.sizes))
        return np.flatnonzero(100 * shared >= percent * (self.sizes + len(one) - shared))


def _components(sets: list[np.ndarray], reps: list[int], percent: int) -> list[int]:
    """The smallest rep that each of the sets reaches through similar ones."""
    index, label, parts = _Index(sets), np.array(reps), len(set(reps))
    for one in sets:
        near = np.unique(label[index.similar(one, percent)])
        if len(near) > 1:
            label[np.isin(label, near)] = near[0]
            parts -= len(near) - 1
            if parts == 1:
                break
    return label.tolist()


def _with_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[dict, np.ndarray]]:
    for piece in pieces(batches, "text"):
        words, counts = column_words(piece.column("text"), lower=True)
        values, sizes = distinct(*shingles(words, counts, n))
        yield from zip(piece.drop_columns("text").to_pylist(), np.split(values, np.cumsum(sizes)[:-1]))


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _within(blocks: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): each member of a block that is not its component's smallest, and that one."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_with_sets(batches, n), key=lambda r: r[0]["block"]):
            rows = list(group)
            reps = [r["rep"] for r, _ in rows]
            label = _components([s for _, s in rows], reps, percent)
            found = [(a, b) for a, b in zip(label, reps) if a != b]
            if found:
                yield batch_of(_PAIR, list(zip(*found)))

    rows = blocks.select("block", "rep", "text").repartition("block").sortWithinPartitions("block")
    return rows.mapInArrow(solve, "a long, b long")


def _across(blocks: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): a member outside its cluster's main component, and one member of each other component like it."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_with_sets(batches, n), key=lambda r: r[0]["block"]):
            members, index = [], None
            for row, one in group:
                if not row["lone"]:  # these come first
                    members.append((row["rep"], row["component"], one))
                    continue
                index = index or (_Index([m[2] for m in members]) if members else None)
                if index is None:
                    continue
                others = {members[i][1]: members[i][0] for i in index.similar(one, percent)}
                others.pop(row["component"], None)
                if others:
                    yield batch_of(_PAIR, [list(others.values()), [row["rep"]] * len(others)])

    rows = blocks.select("block", "lone", "rep", "component", "text").repartition("block").sortWithinPartitions("block", "lone")
    return rows.mapInArrow(meet, "a long, b long")


def _linked(clusters: DataFrame, n: int, percent: int) -> DataFrame:
    """(rep, component) of all members of clusters, given as (rep, cluster, n_shingles, text)."""
    per = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("runs"))
    parts = F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("runs") / BLOCK_RUNS)).cast("int")
    rows = clusters.join(per.select("cluster", parts.alias("parts")), "cluster")
    block = lambda part: F.xxhash64("cluster", part).alias("block")
    home = rows.select("*", block(F.pmod(F.xxhash64("rep"), "parts").cast("int")))
    large = staged(rows.where("parts > 1"), "large")
    order = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("rep"), "rep"))
    pivots = large.select("cluster", "rep", "parts", order.alias("place")).where(F.col("place") <= PIVOTS)  # a group limit
    pivots = large.join(pivots.select("rep"), "rep").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pivots = pivots.where(F.col("part") != F.pmod(F.xxhash64("rep"), "parts"))
    pivots = pivots.select("rep", "text", block(F.col("part").cast("int")))
    links = staged(_within(home.select("rep", "text", "block").unionByName(pivots), n, percent), "links")
    if large.isEmpty():
        return links.select(F.col("b").alias("rep"), F.col("a").alias("component"))

    some = links.join(large.select(F.col("rep").alias("b")), "b", "left_semi")
    small = links.join(large.select(F.col("rep").alias("b")), "b", "left_anti")
    label = components(some, "a", "b").withColumnRenamed("node", "rep")
    known = large.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    main = known.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    main = main.groupBy("cluster").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    known = staged(known.join(main, "cluster"), "known")
    every = known.select(block(F.pmod(F.xxhash64("rep"), "parts").cast("int")), F.lit(False).alias("lone"), "rep", "component", "text")
    lone = known.where("component <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lone = lone.select(block(F.col("part").cast("int")), F.lit(True).alias("lone"), "rep", "component", "text")
    more = _across(every.unionByName(lone), n, percent)
    label = components(staged(some.union(more), "links"), "a", "b")
    return label.select(F.col("node").alias("rep"), "component").union(small.select("b", "a"))


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of their word runs.

    A document's set is its distinct runs of ``words`` words, A-Z lower-cased; a
    shorter text is one run; a null text or one without words has no set and is
    linked with nothing. Two documents link if their similarity is at least
    ``percent`` / 100, decided on the sets. Returns (doc_id, n_shingles,
    component_id, kept): the smallest doc_id reachable, and whether it is the
    document's own. Every row comes back: rows that repeat a doc_id share what
    their text reaches, and a row without a doc_id is a copy of what equals it
    but never the smallest; alone, its component is null. It is kept if alone.

    Equal sets are one class from the start, which its smallest doc_id stands for.
    """
    signed = staged(signatures(docs, id_col, text_col, words), "signatures")
    of_set = ["set_a", "set_b", "n_shingles"]
    filled = signed.where("n_shingles > 0")
    classes = filled.groupBy(of_set).agg(F.min("doc_id").alias("rep"), *[F.max(s).alias(s) for s in _SIG])
    classes = staged(classes, "classes")
    named = classes.where("rep is not null")

    keys = named.select("rep", F.explode(F.array(*_keys())).alias("key"))
    shared = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").drop("last")
    pairs = keys.join(shared, "key").where("rep <> hub").select("hub", "rep").distinct()
    cluster = components(pairs, "hub", "rep").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    cluster = cluster.join(named.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles")), "rep")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    label = _linked(staged(texts.join(cluster, "rep"), "clusters"), words, percent)
    label = label.groupBy("rep").agg(F.min("component").alias("component"))
    label = classes.select(*of_set, "rep").join(label, "rep", "left")
    label = label.select(*of_set, F.coalesce("component", "rep").alias("component_id"))
    rows = signed.select("doc_id", *of_set).join(label, of_set, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return rows.withColumn("kept", kept)


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that stay: of each group the one with the smallest doc_id.

    Rows that repeat that doc_id stay once, by the least text; rows without a
    doc_id all stay. ``one_of_each`` looks at rows instead.
    """
    kept = groups.where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    named = named.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    return named.unionByName(docs.where("doc_id is null"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay: of each group of near copies the one with the smallest doc_id.

    Rows are grouped by an id of their own, so texts that are unlike each other
    stay also under one doc_id; where rows of a group share its smallest doc_id,
    the least digest of the text decides. Of a group's rows without a doc_id one
    stays as well, also beside one with a doc_id.
    """
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = near_dedup(rows, words, percent, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    ids = rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"))
    first = groups.join(ids, "_row").groupBy("_group", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "digest", "_row"))["_row"].alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(docs.columns)
