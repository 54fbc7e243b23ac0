"""WARC archives written and read back, with record boundaries verified by chains.

Archives are plain text files in which every record ends with an empty line, so
Spark writes and splits them. Reading, each task takes the pieces of its split
between magic strings as candidate records and names the offset at which each
one's successor must begin. Within a split, successors are followed at once;
across splits, pointers jump, each twice as far as in the round before, from the
start of every file. What is not reached is magic inside a payload and belongs
to the record before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.arrow import batch_of, pieces, runs, staged
from murmur.session import shared_dir

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Most records of one archive.
RECORDS_PER_FILE = 50_000
#: Parts in which the pages of one payload meet its first page.
PARTS = 8

_FOUND = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("next", pa.int64()), ("leaves", pa.int64()),
     ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64()), ("whole", pa.bool_()), ("nth", pa.int64())]
)
_FOUND_TYPES = (
    "file string, block long, at long, size long, next long, leaves long, page_id long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long, whole boolean, nth long"
)
_RECORD = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_RECORD_TYPES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(url: Column) -> Column:
    """A header value cannot hold line ends."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One WARC record per page as text, in column ``value``.

    Of pages with equal payloads of at least ``least_bytes`` bytes, those with
    the smallest page_id are responses and the others revisit it. A page without
    a page_id never is the one revisited. A null html is an empty payload.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("sha1", pa.string())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            sha1 = [digest(h.encode()) for h in piece.column("html").to_pylist()]
            yield batch_of(schema, [*(piece.column(c) for c in ("page_id", "url", "html")), sha1])

    rows = rows.mapInArrow(sign, "page_id long, url string, html string, sha1 string").withColumn("bytes", F.octet_length("html").cast("long"))
    # Written first, so that Spark knows its size: where few payloads repeat, no page is shuffled.
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # a payload that most pages share, such as none, meets its first page in parts
    every = F.explode(F.array(*[F.lit(n) for n in range(PARTS)])).alias("part")
    repeated = staged(first.where("n > 1").drop("n"), "repeated").select("*", every)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int"))
    rows = rows.join(repeated, ["sha1", "part"], "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull())
    block = F.concat(F.lit(HTTP), F.when(again, "").otherwise(F.col("html")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    named = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(named(F.col("page_id")), F.concat(F.lit("<urn:payload:"), F.col("sha1"), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Refers-To", F.when(again, named(F.col("first")))),
        line("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    rows = records(pages, least_bytes)
    rows.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _parsed(piece: bytes) -> dict | None:
    """The headers of a record that begins here, without its magic."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower()] = value.strip()
    length = head.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in head:
        return None
    return head | {"begins": end + 4, "length": int(length)}


def _page(value: bytes | None) -> int | None:
    number = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(number) if number.lstrip(b"-").isdigit() else None


def _contents(head: dict, block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a whole record."""
    kind = head[b"warc-type"].decode()
    page, refers = _page(head.get(b"warc-record-id")), _page(head.get(b"warc-refers-to"))
    if kind == "revisit":
        stated = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
        return page, int(head.get(b"x-payload-length", b"0")), stated, kind, refers
    payload = block.partition(b"\r\n\r\n")[2] if head.get(b"content-type", b"").startswith(b"application/http") else block
    return page, len(payload), digest(payload), kind, refers


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic strings, in order within (file, block)."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece")
    )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_FOUND``; ``at``, ``next`` and ``leaves`` count from the split's first piece."""
    key, rows, at = None, [], 0

    def split() -> Iterator[pa.RecordBatch]:
        place = {r[2]: r for r in rows}
        for r in reversed(rows):  # a successor lies behind, so its own way out is known
            onward = place.get(r[4])
            r[5] = onward[5] if onward is not None and r[4] > r[2] else r[4]
        for k in range(0, len(rows), 5000):
            yield batch_of(_FOUND, list(zip(*rows[k : k + 5000])))

    for batch in pieces(batches, "piece"):
        for file, block, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "piece"))):
            if (file, block) != key:
                if rows:
                    yield from split()
                key, rows, at = (file, block), [], 0
            head = _parsed(piece)
            start, follows, whole, found = at - len(MAGIC), None, False, (None,) * 5
            if head:
                stop = head["begins"] + head["length"]
                follows = at + stop + len(END)
                whole = len(piece) >= stop
                if whole:
                    found = _contents(head, piece[head["begins"] : stop])
            rows.append([file, block, start, len(piece) + len(MAGIC), follows, None, *found, whole, len(rows)])
            at += len(piece) + len(MAGIC)
    if rows:
        yield from split()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, which pieces the chain that enters it reaches."""
    out = pa.schema([*_FOUND, ("reached", pa.bool_())])
    for group in runs(batches, "split"):
        order = np.argsort(group.column("at").to_numpy())
        group = group.take(pa.array(order))
        at, follows = group.column("at").to_pylist(), group.column("next").to_pylist()
        place = {a: i for i, a in enumerate(at)}
        reached = np.zeros(len(at), bool)
        i = place.get(group.column("enters")[0].as_py())
        while i is not None and not reached[i]:
            reached[i] = True
            i = place.get(follows[i])
        yield batch_of(out, [*(group.column(c.name) for c in _FOUND), reached])


def verified(spark: SparkSession, path: str) -> DataFrame:
    """Every piece of the archives with its offsets in the file and whether the chain reaches it."""
    found = staged(_pieces(spark, path).mapInArrow(_candidates, _FOUND_TYPES), "candidates")
    splits = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    upto = F.sum("bytes").over(Window.partitionBy("file").orderBy("block"))
    splits = splits.select("file", "block", (upto - F.col("bytes")).alias("base"))
    found = found.join(splits, ["file", "block"])
    for c in ("at", "next", "leaves"):
        found = found.withColumn(c, F.col(c) + F.col("base"))
    found = staged(found, "offsets")

    jumps = found.where("next is not null").select("file", "at", F.col("leaves").alias("to"))
    reached = staged(found.where("at = 0").select("file", "at"), "reached")
    seen = reached.count()
    while True:
        further = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        further = further.join(found.select("file", "at"), ["file", "at"], "left_semi")
        reached = staged(reached.union(further).distinct(), "reached")
        now = reached.count()
        if now == seen:
            break
        seen = now
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jumps = staged(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jumps")
    # One chain enters a split once, at the first of its pieces that was reached.
    enters = found.join(reached, ["file", "at"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("enters"))
    rows = found.join(enters, ["file", "block"], "left").withColumn("split", F.xxhash64("file", "block"))
    rows = rows.drop("base").repartition("split").sortWithinPartitions("split")
    return rows.mapInArrow(_walk, _FOUND_TYPES + ", reached boolean")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of a folder of archives.

    A record whose payload holds the magic was cut at it; it is put together
    from the pieces up to its successor. An empty folder gives no rows.
    """
    rows = staged(verified(spark, path), "verified")
    whole = rows.where("reached and whole").select(_RECORD)
    cut = rows.where("reached and not whole").select("file", F.col("at").alias("owner"))
    if cut.isEmpty():
        return whole
    owner = F.max(F.when(F.col("reached"), F.col("at"))).over(Window.partitionBy("file").orderBy("at"))
    some = rows.join(cut.select("file").distinct(), "file", "left_semi")
    parts = some.select("file", "block", "nth", "at", owner.alias("owner")).join(cut, ["file", "owner"])
    numbered = _pieces(spark, path).mapInArrow(_numbered, "file string, block long, nth long, piece binary")
    parts = numbered.join(parts, ["file", "block", "nth"])
    parts = parts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("parts"))  # one record
    return whole.unionByName(parts.select("parts.piece").mapInArrow(_mended, _RECORD_TYPES))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their place within (file, block)."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("nth", pa.int64()), ("piece", pa.binary())])
    key, nth = None, 0
    for batch in pieces(batches, "piece"):
        places = []
        for now in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
            nth, key = (nth + 1, key) if now == key else (0, now)
            places.append(nth)
        yield batch_of(schema, [batch.column("file"), batch.column("block"), places, batch.column("piece")])


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records put together from their pieces; one that the file cuts short is as long as what is there."""
    schema = pa.schema([(c, _FOUND.field(c).type) for c in _RECORD])
    for batch in batches:
        rows = []
        for parts in batch.column("piece").to_pylist():
            piece = MAGIC.encode().join(parts)
            if head := _parsed(piece):
                rows.append(_contents(head, piece[head["begins"] : head["begins"] + head["length"]]))
        if rows:
            yield batch_of(schema, list(zip(*rows)))


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written as WARC records and read back; see ``records`` and ``read_archives``."""
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path)
