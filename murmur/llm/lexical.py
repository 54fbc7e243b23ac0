"""Ranked lexical search by geometric blocks of posting lists.

Documents are indexed in shards of some thousands, each in a task's memory and
searched there. In a shard, a term's posting list is cut into
blocks of documents that are alike: some of its documents are pivots, and each
other one goes with the pivot of the greatest cosine between their impacts. A
block's summary is the greatest impact of each term over its documents, so the
dot product of an item with the summary is an exact bound for all of them. A
search goes through an item's terms, rarest first, skips the blocks whose bound
is under the score of the k-th document so far, and scores the documents of the
others in full; it ends where even the greatest impacts of all terms left stay
under. No document that could be among the k is ever skipped.

A term's block is only met by items with that term, and documents with a rarer
term of the item were met in that term's list. So a summary holds the terms
from its own on, and of these the ones that share an item with it.

Items are taken in blocks of bounded size, whose vocabulary travels with the
tasks; each block of items reads all documents. Documents stay in the task that
reads them, only the terms of items are kept of them, and what is shuffled is
one count a term and at most k rows an item and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.arrow import batch_of, pieces, staged, strings
from murmur.llm.words import BETWEEN_TERMS, hash_words

#: Items and distinct terms of items that are searched at a time.
BLOCK_ITEMS = 2048
BLOCK_TERMS = 1 << 18
#: Documents and postings of a shard of the index.
SHARD_DOCS = 4096
SHARD_POSTINGS = 1 << 19
#: Documents of a block, about.
BLOCK_DOCS = 32
#: Columns that documents are compared in when blocks are formed; more terms are folded into these.
CLUSTER_COLUMNS = 256
#: First-level groups that each item's candidates are ranked in before all of them are.
RANK_GROUPS = 64


def column_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each text, A-Z lower-cased, and how many each has."""
    return hash_words(*strings(column), lower=True, between=BETWEEN_TERMS)


@dataclass
class Items:
    """A block of items over its own vocabulary."""

    rows: list[tuple[int, int | None]]  # a row's number and item_id
    hashes: np.ndarray  # the vocabulary, rarest term first once ``ranked``
    terms: list[np.ndarray]  # per item: its distinct terms, ascending
    times: list[np.ndarray]  # per item: how often each occurs

    def ranked(self, order: np.ndarray) -> Items:
        """The same with ``hashes[order]`` as the vocabulary."""
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        terms, times = [], []
        for t, c in zip(self.terms, self.times):
            new = place[t]
            by = np.argsort(new)
            terms.append(new[by])
            times.append(c[by])
        return Items(self.rows, self.hashes[order], terms, times)

    def partners(self) -> list[np.ndarray]:
        """For each term, the terms from it on that share an item with it."""
        holders: list[list[np.ndarray]] = [[] for _ in self.hashes]
        for terms in self.terms:
            for i, t in enumerate(terms.tolist()):
                holders[t].append(terms[i:])
        return [np.unique(np.concatenate(h)) for h in holders]


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    schema = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.int64()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, counts = column_terms(batch.column("text"))
            lists = np.split(hashes.view(np.int64), np.cumsum(counts)[:-1])
            yield batch_of(schema, [batch.column("row"), batch.column("item_id"), lists])

    rows = items.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(item_col).cast("long").alias("item_id"),
        F.col(text_col).cast("string").alias("text"),
    )
    return staged(rows.mapInArrow(split, "row long, item_id long, terms array<long>"), "items")


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks that a task can hold."""
    held: list[tuple[int, int | None, np.ndarray]] = []
    size = 0

    def made() -> Items:
        every = [np.unique(h, return_counts=True) for *_, h in held]
        vocabulary = np.unique(np.concatenate([t for t, _ in every]))
        return Items([(r, i) for r, i, _ in held], vocabulary, [np.searchsorted(vocabulary, t) for t, _ in every], [c.astype(np.int64) for _, c in every])

    for row in items.where(F.size("terms") > 0).toLocalIterator():
        hashes = np.array(row["terms"], np.int64).view(np.uint64)
        if held and (len(held) >= BLOCK_ITEMS or size + len(hashes) > BLOCK_TERMS):
            yield made()
            held, size = [], 0
        held.append((row["row"], row["item_id"], hashes))
        size += len(hashes)
    if held:
        yield made()


def _forward(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, times) of the documents with at least one term; of their terms, the vocabulary's."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashes, counts = column_terms(batch.column("text"))
            doc = np.repeat(np.arange(len(counts)), counts)
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            known = vocabulary[at] == hashes
            pair, times = np.unique(doc[known] * len(vocabulary) + at[known], return_counts=True)
            ends = np.searchsorted(pair, np.arange(1, len(counts)) * len(vocabulary))
            terms = np.split((pair % len(vocabulary)).astype(np.int32), ends)
            columns = [batch.column("doc_id"), counts, terms, np.split(times.astype(np.int64), ends)]
            yield batch_of(schema, columns).filter(pa.array(counts > 0))

    return docs.mapInArrow(look, "doc_id long, n long, terms array<int>, times array<long>")


@dataclass
class Shard:
    """Some documents by rows of term and impact, and the posting lists over them in blocks with summaries."""

    ids: np.ndarray
    unnamed: np.ndarray  # which documents have no id
    doc_starts: np.ndarray
    doc_terms: np.ndarray
    doc_impacts: np.ndarray
    list_terms: np.ndarray
    list_blocks: np.ndarray  # first block of each list, and the end
    block_starts: np.ndarray  # first member of each block, and the end
    members: np.ndarray
    list_summary: np.ndarray  # first summary entry of each list, and the end
    summary_terms: np.ndarray  # ascending within a list
    summary_blocks: np.ndarray
    summary_most: np.ndarray


def _rows_of(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of some rows, and how many each has."""
    counts = starts[rows + 1] - starts[rows]
    total = int(counts.sum())
    begins = np.cumsum(counts) - counts
    return np.repeat(starts[rows] - begins, counts) + np.arange(total), counts


def _alike(rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n: int) -> np.ndarray:
    """A block for each of ``n`` documents: those nearest to one pivot, cut at about BLOCK_DOCS."""
    _, columns = np.unique(terms, return_inverse=True)
    width = min(CLUSTER_COLUMNS, int(columns.max()) + 1)
    vectors = np.bincount(rows * width + columns % width, impacts, n * width).reshape(n, width).astype(np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    n_pivots = -(-n // BLOCK_DOCS)
    pivots = vectors[np.arange(n_pivots) * n // n_pivots]
    nearness = vectors @ pivots.T
    cluster = np.argmax(nearness, axis=1)
    order = np.lexsort((-nearness[np.arange(n), cluster], cluster))
    by = cluster[order]
    first = np.concatenate(([True], by[1:] != by[:-1]))
    place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    opens = first | (place % (2 * BLOCK_DOCS) == 0)
    block = np.empty(n, np.int64)
    block[order] = np.cumsum(opens) - 1
    return block


def build_shard(ids: list, counts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, partners: list[np.ndarray]) -> Shard:
    """Index some documents: per term the documents alike in blocks, and each block's greatest impacts."""
    starts = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(terms, kind="stable")
    list_terms, firsts = np.unique(terms[order], return_index=True)
    lists = np.split(doc[order], firsts[1:])
    wanted = np.zeros(len(partners), bool)
    list_blocks, block_sizes, members, list_summary = [0], [], [], [0]
    tops: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for t, docs in zip(list_terms.tolist(), lists if len(list_terms) else []):
        places, sizes = _rows_of(starts, docs)
        wanted[partners[t]] = True
        rows, seen, values = np.repeat(np.arange(len(docs)), sizes), terms[places], impacts[places]
        kept = wanted[seen]
        rows, seen, values = rows[kept], seen[kept], values[kept]
        wanted[partners[t]] = False
        block = _alike(rows, seen, values, len(docs)) if len(docs) > BLOCK_DOCS else np.zeros(len(docs), np.int64)
        n_blocks = int(block.max()) + 1
        members.append(docs[np.argsort(block, kind="stable")])
        block_sizes.append(np.bincount(block, minlength=n_blocks))
        key = seen.astype(np.int64) * n_blocks + block[rows]
        by = np.argsort(key, kind="stable")
        key, values = key[by], values[by]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tops.append((key[new] // n_blocks, key[new] % n_blocks, np.maximum.reduceat(values, new)))
        list_blocks.append(list_blocks[-1] + n_blocks)
        list_summary.append(list_summary[-1] + len(new))
    none = [np.zeros(0, np.int64)]
    named = np.array([i is None for i in ids], bool)
    return Shard(
        np.array([0 if i is None else i for i in ids], np.int64), named, starts, terms, impacts,
        list_terms, np.array(list_blocks), np.concatenate(([0], np.cumsum(np.concatenate(block_sizes or none)))),
        np.concatenate(members or none), np.array(list_summary),
        *(np.concatenate([top[i] for top in tops] or none) for i in range(3)),
    )


def _shards(
    batches: Iterable[pa.RecordBatch], place: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, partners: list[np.ndarray]
) -> Iterator[Shard]:
    """The rows of ``_forward`` indexed, some thousands at a time; one document is never cut."""

    def shard(held: list[pa.RecordBatch]) -> Shard:
        batch = pa.concat_batches(held)
        lists = batch.column("terms")
        counts = np.diff(lists.offsets.to_numpy())
        terms = place[lists.flatten().to_numpy()]
        times = batch.column("times").flatten().to_numpy()
        size = np.repeat(25 + 75 * batch.column("n").to_numpy() * n_docs // n_terms, counts)
        impacts = weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * size))
        return build_shard(batch.column("doc_id").to_pylist(), counts, terms, impacts, partners)

    held: list[pa.RecordBatch] = []
    docs = postings = 0
    for batch in batches:
        at = 0
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        while at < batch.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), SHARD_POSTINGS - postings, side="right")
            to = at + min(int(room), SHARD_DOCS - docs)
            if to == at and not held:
                to += 1
            if to > at:
                held.append(batch.slice(at, to - at))
                docs, postings = docs + to - at, postings + int(sizes[at:to].sum())
            at = to
            if at < batch.num_rows:
                yield shard(held)
                held, docs, postings = [], 0, 0
    if held:
        yield shard(held)


class Search:
    """The best documents of each item over the shards seen so far."""

    def __init__(self, items: Items, k: int) -> None:
        self.items, self.k = items, k
        none = np.zeros(0, np.int64)
        self.best = [(none, np.zeros(0, bool), none) for _ in items.rows]  # score, without an id, id
        self.blocks = self.skipped = 0

    def least(self, item: int) -> int:
        """The score that a document must reach."""
        scores = self.best[item][0]
        return int(scores[-1]) if len(scores) == self.k else 1

    def add(self, shard: Shard) -> None:
        vocabulary = len(self.items.hashes)
        most = np.zeros(vocabulary, np.int64)
        np.maximum.at(most, shard.doc_terms, shard.doc_impacts)
        where = np.full(vocabulary, -1)
        where[shard.list_terms] = np.arange(len(shard.list_terms))
        times = np.zeros(vocabulary, np.int64)
        met = np.zeros(len(shard.ids), bool)
        for item in range(len(self.items.rows)):
            terms, counts = self.items.terms[item], self.items.times[item]
            here = where[terms] >= 0
            terms, counts = terms[here], counts[here]
            times[terms] = counts
            left = np.cumsum((counts * most[terms])[::-1])[::-1]
            for i, t in enumerate(terms):
                if left[i] < self.least(item):
                    break
                self._list(shard, item, int(where[t]), terms[i:], counts[i:], times, met)
            times[terms] = 0
            met[:] = False

    def _list(self, shard: Shard, item: int, at: int, terms: np.ndarray, counts: np.ndarray, times: np.ndarray, met: np.ndarray) -> None:
        first, end = int(shard.list_blocks[at]), int(shard.list_blocks[at + 1])
        bounds = np.zeros(end - first, np.int64)
        low, high = int(shard.list_summary[at]), int(shard.list_summary[at + 1])
        entries = shard.summary_terms[low:high]
        begins = low + np.searchsorted(entries, terms, side="left")
        ends = low + np.searchsorted(entries, terms, side="right")
        for b, e, c in zip(begins.tolist(), ends.tolist(), counts.tolist()):
            if e > b:
                bounds[shard.summary_blocks[b:e]] += c * shard.summary_most[b:e]
        order = np.argsort(-bounds, kind="stable")
        self.blocks += len(order)
        for step in range(0, len(order), 8):
            some = order[step : step + 8]
            some = some[bounds[some] >= self.least(item)]
            if len(some) == 0:
                self.skipped += len(order) - step
                return
            self.skipped += min(8, len(order) - step) - len(some)
            docs = shard.members[_rows_of(shard.block_starts, first + some)[0]]
            docs = docs[~met[docs]]
            if len(docs):
                met[docs] = True
                self._score(shard, item, docs, times)

    def _score(self, shard: Shard, item: int, docs: np.ndarray, times: np.ndarray) -> None:
        places, counts = _rows_of(shard.doc_starts, docs)
        sums = np.concatenate(([0], np.cumsum(times[shard.doc_terms[places]] * shard.doc_impacts[places])))
        ends = np.cumsum(counts)
        scores = sums[ends] - sums[ends - counts]
        good = scores >= self.least(item)
        if not good.any():
            return
        docs, (old, unnamed, ids) = docs[good], self.best[item]
        scores, unnamed, ids = np.concatenate((old, scores[good])), np.concatenate((unnamed, shard.unnamed[docs])), np.concatenate((ids, shard.ids[docs]))
        order = np.lexsort((ids, unnamed, -scores))[: self.k]
        self.best[item] = scores[order], unnamed[order], ids[order]


def _search(forward: DataFrame, items: Items, k: int, place: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Each task indexes its documents shard by shard, and carries the best of each item from one to the next."""
    schema = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    partners = items.partners()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, k)
        for shard in _shards(batches, place, weights, n_docs, n_terms, partners):
            search.add(shard)
        for (row, item), (scores, unnamed, ids) in zip(items.rows, search.best):
            n = len(scores)
            if n:
                yield batch_of(schema, [[row] * n, [item] * n, pa.array(ids, mask=unnamed), scores])

    found = forward.where(F.size("terms") > 0).mapInArrow(look, "row long, item_id long, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # the candidates of all tasks in some groups first, so that no task ranks them all
    group = F.pmod(F.xxhash64("doc_id", "score"), F.lit(RANK_GROUPS)).alias("group")
    found = found.select("*", group)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "group").orderBy(*best))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*best))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, all if fewer score above 0.

    Terms are stretches of ASCII letters, digits and characters beyond ASCII, A-Z
    lower-cased; they are told apart by 64-bit hashes. With N documents that have
    a term, L terms in all and n in a document, a term in df documents weighs
    w = floor(1000 ln((2N+2)/(2df+1))), m is 25 + (75 n N) div L, and a document
    scores w * ((10**9 tf) div (1000 tf + 8m)) summed over the item's terms.
    Equal scores go by ascending doc_id, those without an id last.

    Null and empty texts have no terms: such items have no result, and such
    documents count nowhere. Each row is a document and each row of ``items`` an
    item of its own, also where ids repeat or are missing. Empty tables give an
    empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for block in _blocks(_items(items, item_col, item_text_col)):
        forward = staged(_forward(rows, block.hashes), "forward")
        n_docs, n_terms = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_docs == 0:
            break
        df = np.zeros(len(block.hashes), np.int64)
        # one row a term of the block of items, at most
        for row in forward.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[row["term"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        order = np.lexsort((np.arange(len(df)), df))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranked = block.ranked(order)
        found.append(_search(forward, ranked, k, place, weights[order], n_docs, n_terms))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found)
