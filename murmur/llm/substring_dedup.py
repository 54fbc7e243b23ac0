"""Removal of passages that an earlier document holds: seed and extend.

Seeds are winnowed anchors: of the runs of ``SEED`` words within each window of
``min_words`` words, the one with the least hash. Equal windows choose equal
anchors, so a repeated window is always seeded. Documents meet on anchors;
where an anchor occurs in two documents, each occurrence is extended to both
sides into the windows that chose it, these meet by their hash, and adjoining
repeated windows grow into one maximal repeat.

Hashes travel packed: one row holds those that a batch of documents has for one
partition. A batch first settles what repeats within it and sends only its
smallest document for a hash, so a passage that a third of all documents share
costs each batch one entry.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import batch_of, pieces, staged
from murmur.llm.words import column_words, mix, run_hashes, whole_runs

SEED = 6
#: Packed hashes that one task takes at a time.
TASK_HASHES = 2_000_000
#: Text within which a task settles repeats before it sends hashes.
BATCH_BYTES = 16 << 20

#: Entries: a hash, the document and the checksum of its text, and the run of windows that it stands for.
_COLUMNS = ("keys", "docs", "sums", "starts", "counts")
_KINDS = (np.uint64, np.int64, np.uint32, np.int32, np.int32)
#: Parts in which the copies of one text meet their first document.
COPY_PARTS = 8

_PACK = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), *((c, pa.binary()) for c in _COLUMNS)])
_PACK_TYPES = "bucket int, settled boolean, " + ", ".join(f"{c} binary" for c in _COLUMNS)

Entries = tuple[np.ndarray, ...]


def _dump(entries: Entries) -> list[bytes]:
    """Entries as bytes; all but the hashes as differences, which compress."""
    return [entries[0].tobytes(), *(np.diff(e, prepend=e.dtype.type(0)).tobytes() for e in entries[1:])]


def _load(row: dict) -> Entries:
    keys, *rest = (np.frombuffer(row[c], kind) for c, kind in zip(_COLUMNS, _KINDS))
    return keys, *(np.cumsum(e, dtype=e.dtype) for e in rest)


def _join(parts: list[Entries]) -> Entries:
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else tuple(np.zeros(0, k) for k in _KINDS)


def _some(entries: Entries, which: np.ndarray) -> Entries:
    return tuple(e[which] for e in entries)


def _windows(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and anchor hash of every window of ``n`` words."""
    seed = min(SEED, n)
    starts = np.flatnonzero(whole_runs(counts, n))
    grams = run_hashes(words, seed)
    least = grams[starts] if len(starts) else np.zeros(0, np.uint64)
    for j in range(1, n - seed + 1):
        np.minimum(least, grams[starts + j], out=least)
    return starts, np.searchsorted(np.cumsum(counts), starts, side="right"), least


def _told(keys: np.ndarray, docs: np.ndarray, later_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by key and document: which learn that another document has their key, and which are their key's first document's."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(heads, len(keys)))
    later = docs > np.repeat(docs[heads], sizes)
    told = later if later_only else np.repeat(np.logical_or.reduceat(later, heads), sizes)
    return told, ~later


def _by_bucket(entries: Entries, bucket: np.ndarray, buckets: int, settled: bool) -> Iterator[list]:
    """A row for each bucket, its entries by document and place."""
    order = np.lexsort((entries[3], entries[2], entries[1], bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b + 1] > cuts[b]:
            yield [b, settled, *_dump(_some(entries, order[cuts[b] : cuts[b + 1]]))]


def _replies(entries: Entries, buckets: int) -> Iterator[list]:
    """What documents are told, by bucket of the document; hashes are not needed any more."""
    entries = (np.zeros(len(entries[0]), np.uint64), *entries[1:])
    # mixed, as ids in steps of the number of buckets would all share one
    bucket = mix(entries[1].astype(np.int64).view(np.uint64)) % np.uint64(buckets)
    return _by_bucket(entries, bucket.astype(np.int64), buckets, True)


def _packed(entries_of: Callable, buckets: int, later_only: bool) -> Callable:
    """A task that packs the entries of each batch by partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            entries = _join([entries_of(p) for p in pieces([batch], "text")])
            entries = _some(entries, np.lexsort((entries[1], entries[0])))
            told, first = _told(*entries[:2], later_only)
            rows = list(_replies(_some(entries, told), buckets))
            # one entry goes on for a first document that has been told, all for one that may still be
            new = np.concatenate(([True], entries[0][1:] != entries[0][:-1])) if len(first) else first
            sent = _some(entries, first & (~told | new))
            sent = (*sent[:4], np.where(told[first & (~told | new)], 0, sent[4]).astype(np.int32))
            rows += _by_bucket(sent, (sent[0] % np.uint64(buckets)).astype(np.int64), buckets, False)
            if rows:
                yield batch_of(_PACK, list(zip(*rows)))

    return pack


def _met(packs: DataFrame, buckets: int, later_only: bool) -> DataFrame:
    """(doc_id, text_crc, spans): per text the runs of windows, start and count, that another document has too."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            rows = batch.to_pylist()
            settled = [[r["bucket"], True, *(r[c] for c in _COLUMNS)] for r in rows if r["settled"]]
            held += [_load(r) for r in rows if not r["settled"]]
            if settled:
                yield batch_of(_PACK, list(zip(*settled)))
        entries = _join(held)
        entries = _some(entries, np.lexsort((entries[1], entries[0])))
        told, _ = _told(*entries[:2], later_only)
        rows = list(_replies(_some(entries, told & (entries[4] > 0)), buckets))
        if rows:
            yield batch_of(_PACK, list(zip(*rows)))

    schema = pa.schema([("doc_id", pa.int64()), ("text_crc", pa.int64()), ("spans", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, docs, sums, starts, counts = _join([_load(r) for batch in batches for r in batch.to_pylist()])
        order = np.lexsort((starts, sums, docs))
        docs, sums, starts, counts = docs[order], sums[order], starts[order], counts[order]
        new = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (sums[1:] != sums[:-1])))) if len(docs) else []
        rows = []
        for at, to in zip(new, np.append(new[1:], len(docs))):
            rows.append((docs[at], sums[at], _runs(starts[at:to], counts[at:to])))
            if len(rows) == 5000 or to == len(docs):
                yield batch_of(schema, list(zip(*rows)))
                rows = []

    replies = packs.repartition(buckets, "bucket").mapInArrow(meet, _PACK_TYPES)
    return replies.repartition(buckets, "bucket").mapInArrow(gather, "doc_id long, text_crc long, spans binary")


def _runs(starts: np.ndarray, counts: np.ndarray) -> bytes:
    """Runs of windows, sorted by start, with adjoining ones made one."""
    ends = np.maximum.accumulate(starts + counts)
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    first = np.flatnonzero(new)
    return np.stack((starts[first], ends[np.append(first[1:], len(starts)) - 1]), axis=1).astype(np.int32).tobytes()


def _starts(piece: pa.RecordBatch, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows in the rows' ``spans``, as places among the words of the batch, and their rows."""
    begin = np.cumsum(counts) - counts
    spans = [np.frombuffer(s, np.int32).reshape(-1, 2) for s in piece.column("spans").to_pylist()]
    text = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
    flat = np.concatenate(spans) if spans else np.zeros((0, 2), np.int32)
    sizes = (flat[:, 1] - flat[:, 0]).astype(np.int64)
    ends = np.cumsum(sizes)
    at = np.repeat(flat[:, 0] + begin[text] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return at, np.repeat(text, sizes)


def _crc(texts: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode()) for t in texts], np.uint32)


def repeated_spans(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, ...]:
    """What ``substring_dedup`` finds, as three tables.

    ``base``: (doc_id, text_crc, n_words, sha256 of the words, text_md5, copy) for every
    row, where a copy's words are all those of a document with a smaller doc_id.
    ``cut``: (doc_id, text_crc) of those other texts that have repeated windows.
    ``found``: (doc_id, text, spans) of these, with the runs of such windows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_crc", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string()), ("text_md5", pa.string())]
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = [(t or "").encode() for t in piece.column("text").to_pylist()]
            split = [t.split() for t in texts]
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in split]
            md5 = [hashlib.md5(t).hexdigest() for t in texts]
            crc = [zlib.crc32(t) for t in texts]
            yield batch_of(schema, [piece.column("doc_id"), crc, [len(w) for w in split], sha, md5])

    base = staged(rows.mapInArrow(digest, "doc_id long, text_crc long, n_words long, sha256 string, text_md5 string"), "words")
    # texts without a window are nobody's copy; the empty ones would all meet in one task
    long = base.where(F.col("n_words") >= min_words)
    first = long.groupBy("sha256").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")
    # the copies of one text meet their first in parts
    first = first.select("sha256", "first", F.explode(F.array(*[F.lit(n) for n in range(COPY_PARTS)])).alias("part"))
    long = long.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(COPY_PARTS)).cast("int"))
    long = long.join(first, ["sha256", "part"], "left").select("doc_id", "text_crc", "n_words", "sha256", "text_md5", copy)
    base = staged(long.unionByName(base.where(F.col("n_words") < min_words).withColumn("copy", F.lit(False))), "base")

    total = base.agg(F.sum("n_words")).first()[0] or 0
    default = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(default, 1 + total * 2 // max(2, min_words - SEED + 2) // TASK_HASHES)

    def anchors(piece: pa.RecordBatch) -> Entries:
        ids = piece.column("doc_id").to_numpy().astype(np.int64)
        _, counts = words = column_words(piece.column("text"), lower=False)
        starts, text, least = _windows(*words, min_words)
        sums = _crc(piece.column("text").to_pylist())
        if len(starts):  # neighbouring windows mostly choose the same
            new = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]))))
            size = np.diff(np.append(new, len(starts)))
            starts, text, least = starts[new], text[new], least[new]
        else:
            size = np.zeros(0, np.int64)
        place = starts - (np.cumsum(counts) - counts)[text]
        return least, ids[text], sums[text], place.astype(np.int32), size.astype(np.int32)

    named = rows.where("doc_id is not null and text is not null")
    seeds = _met(named.mapInArrow(_packed(anchors, buckets, False), _PACK_TYPES), buckets, False)
    whole = base.groupBy("doc_id").agg(F.min("copy").alias("copy")).where("copy")
    named = named.withColumn("text_crc", F.crc32(F.col("text").cast("binary")))
    seeded = staged(named.join(seeds.join(whole, "doc_id", "left_anti"), ["doc_id", "text_crc"]), "seeded")

    def extended(piece: pa.RecordBatch) -> Entries:
        ids = piece.column("doc_id").to_numpy().astype(np.int64)
        sums = piece.column("text_crc").to_numpy().astype(np.uint32)
        words, counts = column_words(piece.column("text"), lower=False)
        at, text = _starts(piece, counts)
        place = at - (np.cumsum(counts) - counts)[text]
        return run_hashes(words, min_words)[at], ids[text], sums[text], place.astype(np.int32), np.ones(len(at), np.int32)

    found = _met(seeded.mapInArrow(_packed(extended, buckets, True), _PACK_TYPES), buckets, True)
    found = staged(found, "found")
    return base, found.select("doc_id", "text_crc"), seeded.drop("spans").join(found, ["doc_id", "text_crc"]).select("doc_id", "text", "spans")


def covered(piece: pa.RecordBatch, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a batch of ``found`` rows repeated windows cover, and the words of each row."""
    words, counts = column_words(piece.column("text"), lower=False)
    at, _ = _starts(piece, counts)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + min_words, -1)
    return np.cumsum(edge[:-1]) > 0, counts


def substring_dedup(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What stays of each text without the passages of earlier documents.

    A word goes if a window of ``min_words`` words covers it whose words also
    start in a document with a smaller doc_id; windows are those of the input.
    Returns (doc_id, n_words, n_removed, kept_sha256), the digest of the kept
    words joined by one space. Null texts have no words; a row without a doc_id
    keeps all its words and takes none from others; rows that repeat a doc_id
    are one document with several texts and take none from each other.
    """
    base, cuts, found = repeated_spans(docs, min_words, id_col, text_col)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            gone, counts = covered(piece, min_words)
            at, sha, removed = 0, [], []
            for text, n in zip(piece.column("text").to_pylist(), counts):
                mask = gone[at : at + n]
                kept = [w for w, drop in zip(text.encode().split(), mask) if not drop]
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                removed.append(int(mask.sum()))
                at += n
            rows = batch_of(schema, [piece.column("doc_id"), counts, removed, sha])
            yield rows.filter(pa.array(counts > 0))

    changed = found.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    # a text, not a document, is cut: of texts that share a doc_id some may hold no repeat
    same = base.join(cuts, ["doc_id", "text_crc"], "left_anti")
    same = same.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.col("sha256")).alias("kept_sha256"),
    )
    return same.unionByName(changed)


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents with repeated passages cut out of their texts.

    A text without a repeat stays as it is, byte for byte; of others the kept
    words stay with the white space before them. ``n_chars`` follows the text.
    """
    base, _, found = repeated_spans(docs, min_words)
    schema = pa.schema([("doc_id", pa.int64()), ("text_md5", pa.string()), ("left", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            gone, counts = covered(piece, min_words)
            at, md5, left = 0, [], []
            for text, n in zip(piece.column("text").to_pylist(), counts):
                md5.append(hashlib.md5(text.encode()).hexdigest())
                left.append(_left(text, gone[at : at + n]))
                at += n
            yield batch_of(schema, [piece.column("doc_id"), md5, left])

    cuts = found.mapInArrow(cut, "doc_id long, text_md5 string, left string")
    copies = base.where("copy").select("doc_id", "text_md5", F.lit("").alias("left"))
    cuts = cuts.unionByName(copies).groupBy("doc_id", "text_md5").agg(F.min("left").alias("_left"))
    keys = [F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "_left"]
    rows = docs.withColumn("_key", F.md5("text"))
    rows = rows.join(cuts.select(keys), (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_md5")), "left")
    rows = rows.withColumn("text", F.coalesce("_left", "text"))
    chars = F.when(F.col("_left").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return rows.withColumn("n_chars", chars).select(docs.columns)


_WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def _left(text: str, gone: np.ndarray) -> str:
    """The words that stay, each with the white space before it."""
    if not gone.any():
        return text
    kept, end = [], 0
    for word, drop in zip(_WORD.finditer(text), gone):
        if not drop:
            kept.append(text[end : word.end()])
        end = word.end()
    return "".join(kept).strip(" \t\n\x0b\f\r")
