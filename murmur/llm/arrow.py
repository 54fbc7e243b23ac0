"""Arrow batches inside tasks, and tables staged between steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from murmur.session import shared_dir

# Bytes of text a task holds as numpy arrays at a time; one longer text goes alone.
PIECE_BYTES = 2 << 20


#: Where the folders of staged tables are noted, while someone asks for it.
_NOTED: list[list[str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Lineage ends at the files, so a lost executor costs its tasks, not the
    steps before them. The folder goes when the driver ends.
    """
    path = shared_dir(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    for noted in _NOTED:
        noted.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noting_staged() -> Iterator[list[str]]:
    """A list that gets the folder of every table staged meanwhile."""
    noted: list[str] = []
    _NOTED.append(noted)
    try:
        yield noted
    finally:
        _NOTED.remove(noted)


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    for name in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    buffers = column.buffers()
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = strings(batch.column(column))[1][1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """One batch for each value of the long ``key``, by which the rows are sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield _joined(held)
            held = []
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield _joined(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
