"""Bounded samples that depend on the rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def least_hashed(rows: DataFrame, hashed: Column, tie: str, most: int) -> DataFrame:
    """The ``most`` rows with the least 64-bit hash, which must differ from row to row but for chance.

    All partitions would send ``most`` rows to one task for that. So rows are
    counted first, and only those with hashes low enough for about three times
    as many go on.
    """
    count = rows.count()
    if count > 6 * most:
        rows = rows.where(hashed < int(-(2**63) + 2**64 * (3 * most / count)))
    return rows.orderBy(hashed, tie).limit(most)
