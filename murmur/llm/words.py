"""Words of many texts as arrays of 64-bit hashes.

A word is a run of bytes other than ASCII white space. Its hash depends on its
bytes alone, so equal words hash alike in every task; different ones differ but
for the chance of 64 bits. All texts of a batch are hashed in one go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from murmur.llm.arrow import strings

_BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: Multipliers of the words of a run.
_PLACES = mix(np.arange(1000, 1256, dtype=np.uint64)) | np.uint64(1)


class _Powers:
    """Powers of the base and of its inverse, as far as a block is long."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, _BLOCK)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up, self.down


_POWERS = _Powers()


#: ASCII but letters and digits, which part terms.
BETWEEN_TERMS = np.arange(256) < 128
BETWEEN_TERMS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def hash_words(
    data: np.ndarray, bounds: np.ndarray, lower: bool, between: np.ndarray = _SPACE, first_bytes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has.

    ``between`` marks the bytes that part words. With ``first_bytes``, each word
    also gives the hashes of so many of its first bytes, all its values in a row.
    """
    size = len(data)
    if size == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    inside = ~between[data]
    full = bounds[1:] > bounds[:-1]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = bounds[:-1][full]
    opens[first] = inside[first]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = bounds[1:][full] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)  # ends: the last byte of each word
    counts = np.diff(np.searchsorted(starts, bounds))
    hashes = np.empty((len(starts), 1 + len(first_bytes)), np.uint64)
    table = _LOWER if lower else _BYTES
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK)))
        stop = ends[to - 1] + 1
        up, down = _POWERS.to(stop - base)
        terms = table[data[base:stop]]
        terms *= up[: stop - base]
        sums = np.cumsum(terms, dtype=np.uint64)
        s, e = starts[at:to] - base, ends[at:to] - base
        before = sums[s] - terms[s]
        for k, most in enumerate((0, *first_bytes)):
            last = np.minimum(e, s + most - 1) if most else e
            hashes[at:to, k] = mix((sums[last] - before) * down[s] + (last - s + 1).astype(np.uint64))
        at = to
    return hashes.reshape(-1), counts * hashes.shape[1]


def column_words(column: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    return hash_words(*strings(column), lower)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, whatever text they stand in."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1] * _PLACES[0]
    for j in range(1, n):
        out += words[j : len(words) - n + 1 + j] * _PLACES[j % 256] if j < 256 else mix(words[j : len(words) - n + 1 + j] + np.uint64(j))
    return mix(out + np.uint64(n))


def whole_runs(counts: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` words stand in one text, as a mask over ``run_hashes``."""
    total = int(counts.sum())
    if total < n:
        return np.zeros(0, bool)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(total)  # words from here to the end of the text
    return (left >= n)[: total - n + 1]


def shingles(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word runs of each text, and how many each has.

    A text of fewer words has one run, all its words; without words it has none.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    out_counts = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.empty(int(out_counts.sum()), np.uint64)
    runs, whole = run_hashes(words, n), whole_runs(counts, n)
    at = np.cumsum(out_counts) - out_counts
    long = np.repeat(counts >= n, out_counts)
    out[long] = runs[whole]
    for c in range(1, n):
        short = np.flatnonzero(counts == c)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for j in range(c):
                total += words[begins[short] + j] * _PLACES[j % 256]
            out[at[short]] = mix(total + np.uint64(c))
    return out, out_counts


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and how many."""
    parts, sizes, at = [], np.zeros(len(counts), np.int64), 0
    for i, n in enumerate(counts):
        part = np.sort(values[at : at + n])
        if n > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        parts.append(part)
        sizes[i] = len(part)
        at += n
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes
