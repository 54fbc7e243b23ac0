"""Packing documents into training sequences with a grouping genetic algorithm.

Documents are cut to pieces, the pieces shorter than a sequence are dealt by
hash to shards of some thousands, and each shard is packed by islands. An
island breeds packings whose genes are whole sequences: well-filled sequences of
one parent are injected into the other, whose sequences with a piece in common
go, as do its emptiest ones. The pieces displaced so take the place of smaller
ones where that fills a sequence better, and what is left is placed by best fit.
An island breeds until no child has been better for a while, or none can be, as
its packing meets a lower bound. Between epochs, islands pass their elite to the
next one.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import batch_of, pieces, staged
from murmur.llm.tokens import encoder_of

CAPACITY = 1024
#: Pieces a shard has, about.
SHARD = 4096
ISLANDS, EPOCHS, POPULATION = 2, 2, 4
#: Children without progress after which an island stops.
PATIENCE = 8
#: Tokens of room that a well-filled sequence may have, and the share of such ones that is injected.
WELL_FILLED, INJECTED = 4, 0.3
#: One in so many sequences of the host, the emptiest, is given up.
EMPTIED = 20


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first may be shorter than the others."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null text is empty."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for part in pieces(batches, "text"):
            rows = []
            ids_of = encoder.ids([t or "" for t in part.column("text").to_pylist()])
            for doc, ids in zip(part.column("doc_id").to_pylist(), ids_of):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            yield batch_of(schema, list(zip(*rows)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Sequences by the room left in them; finds the fullest that still takes a piece."""

    def __init__(self, capacity: int) -> None:
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set where some sequence has room r
        self.bins: list[list[int]] = []
        self.capacity = capacity

    def add(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.bins))
        self.rooms |= 1 << room
        self.bins.append(items)

    def place(self, item: int, size: int) -> None:
        fits = self.rooms >> size
        if not fits:
            self.add([item], self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1
        at = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms ^= 1 << room
        self.bins[at].append(item)
        self.by_room[room - size].append(at)
        self.rooms |= 1 << room - size


def best_fit(order: list[int], sizes: list[int], capacity: int, kept: list[list[int]] = ()) -> list[list[int]]:
    """The kept sequences, filled up, and new ones, by placing pieces in the order given."""
    bins = _Bins(capacity)
    for items in kept:
        bins.add(list(items), capacity - sum(sizes[i] for i in items))
    for i in order:
        bins.place(i, sizes[i])
    return bins.bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Sequences that any packing needs (the bound L2 of Martello and Toth).

    For each k up to half the capacity: pieces too long to share a sequence with
    one of k are alone, those over half never meet each other, and what they
    leave must take those from k on.
    """
    n = np.sort(np.asarray(sizes, np.int64))
    sums = np.concatenate(([0], np.cumsum(n)))
    half = int(np.searchsorted(n, capacity // 2, side="right"))
    best = -(-int(sums[-1]) // capacity)
    for k in (0, *np.unique(n[:half]).tolist()):
        low, high = int(np.searchsorted(n, k)), int(np.searchsorted(n, capacity - k, side="right"))
        room = (high - half) * capacity - int(sums[high] - sums[half])
        over = int(sums[half] - sums[low]) - room
        best = max(best, len(n) - half + max(0, -(-over // capacity)))
    return best


def _exchanged(displaced: list[int], sizes: list[int], bins: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """The sequences with one piece each, at most, replaced by the displaced one that fills it best.

    ``displaced`` is left with the pieces without a place, longest first.
    """
    pool = sorted((sizes[i], i) for i in displaced)
    out = []
    for room, items in bins:
        gain, place, taken = 0, 0, 0
        for at, i in enumerate(items) if room else ():
            k = bisect_right(pool, (sizes[i] + room, len(sizes))) - 1
            if k >= 0 and pool[k][0] - sizes[i] > gain:
                gain, place, taken = pool[k][0] - sizes[i], at, k
        if gain:
            items = list(items)
            _, new = pool.pop(taken)
            insort(pool, (sizes[items[place]], items[place]))
            items[place] = new
        out.append((room - gain, items))
    displaced[:] = [i for _, i in reversed(pool)]
    return out


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """A child of the host ``a`` with well-filled sequences of ``b``."""
    rooms = lambda bins: [(capacity - sum(sizes[i] for i in items), items) for items in bins]
    well = [(room, items) for room, items in rooms(b) if room <= WELL_FILLED and rng.random() < INJECTED]
    used = {i for _, items in well for i in items}
    host = sorted((h for h in rooms(a) if used.isdisjoint(h[1])), key=lambda h: h[0])
    stay = len(host) - -(-len(host) // EMPTIED)
    held = used.union(*(items for _, items in host[:stay]))
    displaced = [i for i in range(len(sizes)) if i not in held]
    bins = _exchanged(displaced, sizes, host[:stay] + well)
    return best_fit(displaced, sizes, capacity, [items for _, items in bins])


def _fitness(bins: list[list[int]], sizes: list[int]) -> tuple[int, int]:
    """Fewer sequences first, then fuller ones."""
    return len(bins), -sum(sum(sizes[i] for i in b) ** 2 for b in bins)


def evolve(sizes: list[int], capacity: int, seed: int, immigrants: list[list[list[int]]]) -> list[list[int]]:
    """The best packing that one island finds in an epoch."""
    rng = random.Random(seed)
    bound = lower_bound(sizes, capacity)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = sorted(((_fitness(p, sizes), p) for p in (*immigrants, best_fit(order, sizes, capacity))), key=lambda x: x[0])
    if len(people[0][1]) <= bound:
        return people[0][1]
    while len(people) < POPULATION:
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + 0.2 * rng.random()))
        packing = best_fit(order, sizes, capacity)
        people.append((_fitness(packing, sizes), packing))
    still = 0
    while still < PATIENCE and len(people[0][1]) > bound:
        (_, a), (_, b) = rng.sample(people, 2)
        child = crossover(a, b, sizes, capacity, rng)
        best = people[0][0]
        people = sorted([*people, (_fitness(child, sizes), child)], key=lambda x: x[0])[: max(POPULATION, len(immigrants))]
        still = 0 if people[0][0] < best else still + 1
    return people[0][1]


def _labels(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, items in enumerate(bins):
        out[items] = k
    return out.tobytes()


def _bins(labels: bytes) -> list[list[int]]:
    which = np.frombuffer(labels, np.int32)
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.diff(which[order])) + 1
    return [part.tolist() for part in np.split(order, cuts)]


_ISLAND = "shard long, island int, uids binary, sizes binary, labels binary, bins int"
_ISLAND_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("island", pa.int32()), ("uids", pa.binary()), ("sizes", pa.binary()), ("labels", pa.binary()), ("bins", pa.int32())]
)


def _epoch(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """Each island breeds from its own elite and that of the island before it in the ring."""
    def breed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32).tolist()
                guests = [_bins(e) for e in row["elites"] or () if e]
                best = evolve(sizes, capacity, hash((row["shard"], row["island"], epoch)), guests)
                columns = [row["shard"], row["island"], row["uids"], row["sizes"], _labels(best, len(sizes)), len(best)]
                yield batch_of(_ISLAND_SCHEMA, [[c] for c in columns])

    return islands.mapInArrow(breed, _ISLAND)


def pack(items: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid, length) of less than ``capacity``.

    Sequence ids are numbered within a shard; offsets are gapless from 0.
    """
    count = items.count()
    shards = max(1, round(count / SHARD))
    spread = max(1, min(shards * islands, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = items.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    lists = rows.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("all"))  # SHARD, about
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, every in zip(batch.column("shard").to_pylist(), batch.column("all")):
                uids = every.values.field("uid").to_numpy().astype(np.int64).tobytes()
                sizes = every.values.field("length").to_numpy().astype(np.int32).tobytes()
                for k in range(islands):
                    yield batch_of(_ISLAND_SCHEMA, [[shard], [k], [uids], [sizes], [None], [None]])

    now = lists.mapInArrow(settle, _ISLAND)
    for epoch in range(epochs):
        if epoch == 0:
            now = now.withColumn("elites", F.array(F.lit(None).cast("binary")))
        else:
            from_before = now.select("shard", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.col("labels").alias("guest"))
            now = now.join(from_before, ["shard", "island"]).withColumn("elites", F.array("labels", "guest"))
        now = staged(_epoch(now.repartition(spread, "shard", "island"), capacity, epoch), "islands")

    out = pa.schema([("uid", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uids, sizes = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                which = np.frombuffer(row["labels"], np.int32)
                order = np.argsort(which, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.searchsorted(which[order], which[order])
                begin = ends - sizes[order]
                yield batch_of(out, [uids[order], which[order].astype(np.int64) * shards + row["shard"], begin - begin[first]])

    best = now.groupBy("shard").agg(F.min_by(F.struct("uids", "sizes", "labels"), F.struct("bins", "island")).alias("best"))
    best = best.select("shard", "best.*")
    return best.mapInArrow(place, "uid long, sequence_id long, offset long")


def best_fit_packing(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document's pieces with their place in a sequence of at most ``capacity`` tokens.

    A document is the ids of its whole text, as the file's tokenizer gives them
    (added tokens in a text included), and ``end_id``; a null text is empty, so
    has one token. Returns (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset). Rows that repeat or lack a doc_id are documents of
    their own. An empty table gives no rows.
    """
    cuts = token_pieces(docs, path, capacity, end_id, id_col, text_col)
    cuts = staged(cuts.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    short = cuts.where(F.col("length") < capacity)
    packed = pack(short.select("uid", "length"), capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Full pieces are sequences of their own, numbered below zero.
    full = cuts.where(F.col("length") == capacity).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.join(packed, "uid").select(*columns, "sequence_id", "offset").unionByName(full)
