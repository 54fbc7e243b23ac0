"""Approximate nearest neighbours by cosine: inverted lists and an adaptive dimension scan.

Unit vectors are rotated at random, so that any of their dimensions estimate a
distance, and dealt to the lists of centroids fitted on a bounded sample. A list
is cut into blocks. Where a block meets the queries that probe its list,
distances grow by blocks of columns; after each, a hypothesis test abandons the
candidates whose partial distance says that they are farther than what the query
has already. The survivors are scored exactly on the original vectors. A query
left with fewer than it asked for meets every block again, without a test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.arrow import batch_of, staged
from murmur.llm.sampling import least_hashed

#: Vectors, taken by least hash, that the lists are fitted on; most lists; share of the sample's neighbours to reach.
SAMPLE, MOST_LISTS, REACH = 16_384, 1024, 0.99
#: Candidates a block has, about, and queries that meet it at a time.
BLOCK, QUERIES = 4096, 256
#: Columns after which candidates are tested, as shares of all, and the test's width.
COLUMNS, WIDTH = (0.125, 0.25, 0.5, 0.75, 1.0), 2.6
#: Pairs that are scored exactly at a time.
PAIRS = 1 << 16
SEED = 11


class Lists:
    """Centroids of the lists and how many of them a query probes."""

    def __init__(self, sample: np.ndarray, total: int, k: int) -> None:
        rng = np.random.default_rng(SEED)
        dims = sample.shape[1]
        self.turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0].astype(np.float32)
        sample = np.ascontiguousarray(sample @ self.turn, dtype=np.float32)
        n = int(min(MOST_LISTS, len(sample), max(1, round(total**0.5))))
        centers = sample[rng.choice(len(sample), n, replace=False)]
        for _ in range(8):
            nearest = (sample @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, nearest, sample)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(length > 0, sums / np.maximum(length, 1e-12), centers).astype(np.float32)
        self.centers = centers
        nearest = (sample @ centers.T).argmax(axis=1)
        # how far down a query's order of lists its neighbours in the sample stand
        asked = sample[:: max(1, len(sample) // 512)]
        near = asked @ sample.T
        top = np.argsort(-near, axis=1, kind="stable")[:, 1 : k + 1]  # the first is the query itself
        place = np.argsort(np.argsort(-(asked @ centers.T), axis=1, kind="stable"), axis=1)
        depth = np.take_along_axis(place, nearest[top], axis=1)
        self.probes = int(min(n, 1 + np.quantile(depth, REACH))) if depth.size else n
        self.sample, self.sample_list = sample, nearest

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.centers.T).argmax(axis=1)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector by the power of two that brings its largest component to under 1.

    That changes no cosine and no digit, but squares of very large or very small
    components then neither overflow nor vanish.
    """
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return _scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(np.float64))


def _unit(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32) @ turn


def scan(cand: np.ndarray, asked: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, squared distance) of the pairs that no test abandoned.

    ``limit`` is a squared distance within which each query is known to have
    ``k`` neighbours in the lists it probes; the first candidates may lower it.
    """
    dims = cand.shape[1]
    ends = sorted({max(1, round(share * dims)) for share in COLUMNS})
    first = cand[: max(4 * k, 32)]
    if len(first) > k:
        full = ((asked**2).sum(1)[:, None] + (first**2).sum(1)) - 2 * asked @ first.T
        limit = np.minimum(limit, np.partition(full, k, axis=1)[:, k])  # one of them may be the query itself
    done = ends[0]
    part = (asked[:, :done] ** 2).sum(1)[:, None] + (cand[:, :done] ** 2).sum(1) - 2 * asked[:, :done] @ cand[:, :done].T
    q, c = np.nonzero(part * (dims / done) <= (limit * (1 + WIDTH / done**0.5) ** 2)[:, None] + 1e-4)  # rounding, where distances are 0
    far = part[q, c]
    for end in ends[1:]:
        far = far + ((cand[c, done:end] - asked[q, done:end]) ** 2).sum(axis=1)
        done = end
        keep = far * (dims / done) <= limit[q] * ((1 + WIDTH / done**0.5) ** 2 if done < dims else 1) + 1e-4
        q, c, far = q[keep], c[keep], far[keep]
    return q, c, far


def every_pair(cand: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``scan`` without a test: all pairs."""
    far = (asked**2).sum(1)[:, None] + (cand**2).sum(1) - 2 * asked @ cand.T
    q, c = np.indices(far.shape).reshape(2, -1)
    return q, c, far.ravel()


_HIT = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best(query: dict, block: dict, k: int, exact: bool) -> pa.RecordBatch | None:
    """Each query's ``k`` best candidates of one block by exact cosine; of all of them if ``exact``."""
    if exact:
        q, c, far = every_pair(block["unit"], query["unit"])
    else:
        q, c, far = scan(block["unit"], query["unit"], query["limit"].copy(), k)
    other = query["uid"][q] != block["uid"][c]
    q, c, far = q[other], c[other], far[other]
    if not len(q):
        return None
    order = np.lexsort((far, q))
    q, c, far = q[order], c[order], far[order]
    heads = np.searchsorted(q, q)
    kth = far[np.minimum(heads + k - 1, np.searchsorted(q, q, side="right") - 1)]
    keep = far <= kth + 1e-4  # ties and rounding are left to the exact score
    q, c = q[keep], c[keep]
    score = np.empty(len(q))
    for at in range(0, len(q), PAIRS):
        a, b = query["vector"][q[at : at + PAIRS]], block["vector"][c[at : at + PAIRS]]
        score[at : at + PAIRS] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    order = np.lexsort((block["uid"][c], block["id"][c], -score, q))
    q, c, score = q[order], c[order], score[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, c, score = q[top], c[top], score[top]
    return batch_of(_HIT, [query["uid"][q], query["id"][q], block["uid"][c], block["id"][c], score])


def nearest(table: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``.

    Candidates are all rows but the query's own; ties go to the smaller id. A
    vector that is null, zero, of another length than most, or that holds a null
    or a value that is not finite takes no part, nor does a row without an id.
    Components may be as large or small as doubles are.
    Rows that repeat an id are candidates and queries of their own, told apart by
    their place; each then has its ranks. With fewer candidates than ``k`` all
    are returned.
    """
    spark = table.sparkSession
    values = F.col("vector")
    good = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where("id is not null and vector is not null").where(good).withColumn("uid", F.monotonically_increasing_id())
    rows = staged(rows, "vectors")
    sizes = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = sizes
    rows = rows.where(F.size("vector") == dims)
    sample = least_hashed(rows.select("uid", "vector"), F.xxhash64(F.lit(SEED), "uid"), "uid", SAMPLE).toPandas()
    uids = sample["uid"].to_numpy()
    sample = _scaled(np.stack(sample["vector"].to_numpy()))
    lists = Lists((sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32), total, k)
    shared = spark.sparkContext.broadcast((lists, uids))

    assigned = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("list", pa.int32()), ("vector", pa.list_(pa.float64()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value[0]
        for batch in batches:
            unit = _unit(_vectors(batch.column("vector"), dims), index.turn)
            yield batch_of(assigned, [batch.column("uid"), batch.column("id"), index.nearest(unit).astype(np.int32), batch.column("vector")])

    dealt = rows.select("uid", "id", "vector").mapInArrow(assign, "uid long, id long, list int, vector array<double>")
    dealt = staged(dealt, "dealt")
    filled = dict(dealt.groupBy("list").count().collect())  # a row a list
    counts = np.array([filled.get(i, 0) for i in range(len(lists.centers))])
    blocks = np.maximum(1, -(-counts // BLOCK))
    base = np.concatenate(([0], np.cumsum(blocks)))

    probing = pa.schema([("block", pa.int64()), ("limit", pa.float32()), ("uid", pa.int64()), ("id", pa.int64()), ("vector", pa.list_(pa.float64()))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, own = shared.value
        for batch in batches:
            unit = _unit(_vectors(batch.column("vector"), dims), index.turn)
            order = np.argsort(-(unit @ index.centers.T), axis=1, kind="stable")
            for i, uid in enumerate(batch.column("uid").to_pylist()):
                upto = np.cumsum(counts[order[i]])
                n = max(index.probes, int(np.searchsorted(upto, k + 1)) + 1)  # k candidates and itself
                # of lists that are scanned, or the limit rests on neighbours that are never met
                some = np.isin(index.sample_list, order[i, : min(n, 4)]) & (own != uid)
                far = ((index.sample[some] - unit[i]) ** 2).sum(axis=1)
                limit = np.partition(far, k - 1)[k - 1] if len(far) >= k else np.inf
                found = np.concatenate([np.arange(base[x], base[x + 1]) for x in order[i, :n]])
                row = batch.slice(i, 1)
                again = pa.array(np.zeros(len(found), np.int64))
                yield batch_of(
                    probing,
                    [found, np.full(len(found), limit, np.float32), *(row.column(c).take(again) for c in ("uid", "id", "vector"))],
                )

    queries = dealt.where(F.col("id") % every == 0).select("uid", "id", "vector")
    asked = queries.mapInArrow(probe, "block long, limit float, uid long, id long, vector array<double>").withColumn("asks", F.lit(True))
    starts = F.get(F.split(F.lit(",".join(map(str, base))), ",").cast("array<long>"), F.col("list"))  # a number a list
    parts = F.get(F.split(F.lit(",".join(map(str, blocks))), ",").cast("array<long>"), F.col("list"))
    held = dealt.select((starts + F.pmod(F.xxhash64("uid"), parts)).alias("block"), F.lit(0.0).cast("float").alias("limit"), "uid", "id", "vector")
    held = held.withColumn("asks", F.lit(False))

    def meet(batches: Iterator[pa.RecordBatch], exact: bool = False) -> Iterator[pa.RecordBatch]:
        index = shared.value[0]
        now, parts_held, block = None, [], None
        for batch in batches:
            keys = batch.column("block").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                part, key = batch.slice(start, stop - start), int(keys[start])
                if key // 2 != now:
                    now, parts_held, block = key // 2, [], None
                if key % 2 == 0:
                    parts_held.append(part)
                    continue
                if block is None and parts_held:
                    block = _loaded(pa.concat_batches(parts_held), dims, index.turn)
                for at in range(0, part.num_rows if block else 0, QUERIES):
                    hits = _best(_loaded(part.slice(at, QUERIES), dims, index.turn), block, k, exact)
                    if hits is not None:
                        yield hits

    def ranked(asked: DataFrame, work: Callable) -> DataFrame:
        met = held.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks")
        met = met.mapInArrow(work, "query long, query_id long, uid long, vec_id long, score double")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = staged(ranked(asked, meet), "found")
    # the test may have abandoned candidates of a query until fewer than k were left
    full = found.groupBy(F.col("query").alias("uid")).count().where(F.col("count") >= min(k, total - 1))
    short = staged(queries.join(full, "uid", "left_anti"), "short")
    result = ["query_id", "rank", "vec_id", "score"]
    if total == 1 or short.isEmpty():
        return found.select(result)
    again = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(base[-1]) - 1)))).withColumn("block", F.col("block").cast("long"))
    again = again.select("block", F.lit(float("inf")).cast("float").alias("limit"), "uid", "id", "vector", F.lit(True).alias("asks"))
    found = found.join(short.select(F.col("uid").alias("query")), "query", "left_anti")
    return found.select(result).unionByName(ranked(again, partial(meet, exact=True)).select(result))


def _loaded(batch: pa.RecordBatch, dims: int, turn: np.ndarray) -> dict:
    vector = _vectors(batch.column("vector"), dims)
    get = lambda c: batch.column(c).to_numpy()
    return {"vector": vector, "unit": _unit(vector, turn), "uid": get("uid"), "id": get("id"), "limit": get("limit")}
