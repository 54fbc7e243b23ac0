"""Periodic runs of words: stretches that repeat with one period.

A run is a stretch of consecutive words whose smallest period is q, that is at
least ``max(least, 3 * q)`` words long, and that neither neighbouring word
extends with the same period. Every run of every text is found, whatever its
period.

Periods under 32 are scanned at their lag. Longer ones are found by minimizers,
scale by scale: scale s looks for periods from 2**s up to twice that. Its units
are grams of k = 2**(s-1) words, its windows are w = 2**(s-2) + 1 grams wide. A
window with all it looks at spans 2**s words, no more than the period, so inside
a run each window's minimum stands again one period on, and there is a pair of
equal minimizers just so far apart. Every pair at a distance of the scale is
extended both ways, word by word.

A gram that starts at least one period into a run of a period up to k/2, and ends
in it, is no candidate for a minimum; these runs are known from the scales
before. So equal minimizers are over k/2 apart, each has at most eight partners
at its scale, and no repetitive text makes more. A longer run can't consist of
such grams only, or the shorter period would be its own.

Words are compared by 64-bit hashes. Each text is worked on by itself, in the
task that reads it; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.arrow import batch_of, pieces
from murmur.llm.words import column_words, mix

#: Scale of the first minimizers; shorter periods are scanned directly.
FIRST_SCALE = 5
#: Repetitive stretches noted for the scales after, if shorter than a run may be: one gram of the first scale.
NOTED = 1 << (FIRST_SCALE - 1)
#: Words looked at on either side before a pair is extended.
_PROBES = 8


def _apart(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in a row with fillers between, which equal nothing: (words, first of each text, end of each)."""
    gap = 1 << FIRST_SCALE
    starts = np.cumsum(counts + gap) - counts
    total = int(counts.sum())
    out = mix(np.arange(1, total + gap * (len(counts) + 1) + 1, dtype=np.uint64) + np.uint64(1 << 63))
    before = np.cumsum(counts) - counts
    out[np.repeat(starts - before, counts) + np.arange(total)] = hashes
    return out, starts, starts + counts


def _lag_stretches(words: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches with period ``lag`` of ``least`` words or more."""
    same = np.flatnonzero(words[lag:] == words[:-lag])
    if len(same) == 0:
        return []
    cut = np.flatnonzero(np.diff(same) != 1)
    first = same[np.concatenate(([0], cut + 1))]
    last = same[np.concatenate((cut, [len(same) - 1]))]
    long = last - first + 1 + lag >= least
    return list(zip(first[long].tolist(), (last[long] + 1 + lag).tolist()))


def _divisors(n: int) -> list[int]:
    """n over each of its prime factors."""
    out, rest, p = [], n, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(n // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return out + [n // rest] if rest > 1 else out


def _smallest(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no divisor of the period is one; as the stretch holds three periods, no other could be."""
    for d in _divisors(period):
        if words[start] == words[start + d] and np.array_equal(words[start : end - d], words[start + d : end]):
            return False
    return True


def _extended(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch with period ``lag`` around the equal words at ``at`` and ``at + lag``."""
    end, step = at, 64
    while True:
        same = words[end : end + step][: max(0, len(words) - lag - end)] == words[end + lag : end + lag + step]
        if same.all() and len(same) == step:
            end, step = end + step, step * 2
            continue
        end += len(same) if same.all() else int(np.argmin(same))
        break
    start, step = at, 64
    while True:
        low = max(0, start - step)
        same = words[low:start] == words[low + lag : start + lag]
        if same.all() and start - low == step:
            start, step = low, step * 2
            continue
        start = low if same.all() else start - int(np.argmin(same[::-1]))
        break
    return start, end + lag


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _minimizers(grams: np.ndarray, known: list[tuple[int, int, int]], k: int, width: int) -> np.ndarray:
    """Positions of the least gram of each window, those inside known runs of periods up to k/2 left out."""
    n = len(grams)
    inside = np.zeros(n + 1, np.int32)
    for start, end, period in known:
        low, high = start + period, end - k + 1
        if 2 * period <= k and low < high:
            inside[low] += 1
            inside[min(high, n)] -= 1
    # the high bits of the gram, then its place: one number to take the least of
    low_bits = np.uint64(int(n).bit_length())
    keys = (grams >> low_bits << low_bits) | np.arange(n, dtype=np.uint64)
    none = np.uint64(2**64 - 1)
    keys[np.cumsum(inside[:-1]) > 0] = none
    least = _window_minima(keys, width)
    least = least[np.concatenate(([True], least[1:] != least[:-1]))]
    least = least[least != none]
    # a place that is least again after a smaller one has left the window
    return np.unique((least & ((np.uint64(1) << low_bits) - np.uint64(1))).astype(np.int64))


def _pairs(grams: np.ndarray, places: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal minimizers from ``low`` to under ``high`` apart."""
    values = grams[places]
    order = np.lexsort((places, values))
    values, places = values[order], places[order]
    at, lag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    j = 1
    while j < len(places):
        apart = places[j:] - places[:-j]
        near = (values[j:] == values[:-j]) & (apart < high)
        if not near.any():
            break
        hit = near & (apart >= low)
        at.append(places[:-j][hit])
        lag.append(apart[hit])
        j += 1
    return np.concatenate(at), np.concatenate(lag)


def _likely(words: np.ndarray, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Pairs whose lag holds at probes over one period before or after; a run of three periods has one of these."""
    n = len(words)
    ahead, behind = np.ones(len(at), bool), np.ones(len(at), bool)
    for i in range(_PROBES):
        step = lag * i // _PROBES
        x = np.minimum(at + step, n - 1)
        ahead &= (at + step + lag < n) & (words[x] == words[np.minimum(x + lag, n - 1)])
        x = np.maximum(at - 1 - step, 0)
        behind &= (at - 1 - step >= 0) & (words[x] == words[np.minimum(x + lag, n - 1)])
    return ahead | behind


def find_runs(hashes: np.ndarray, counts: np.ndarray, least: int = 24) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, in order, from its words' hashes."""
    words, starts, ends = _apart(hashes, counts)
    noted: list[tuple[int, int, int]] = []  # start, end, period in ``words``
    for lag in range(1, 1 << FIRST_SCALE):
        for start, end in _lag_stretches(words, lag, max(min(NOTED, least), 3 * lag)):
            if _smallest(words, start, end, lag):
                noted.append((start, end, lag))
    grams, k = words, 1
    scale = FIRST_SCALE
    most = int(counts.max()) if len(counts) else 0
    while 3 << scale <= most:
        while k < 1 << (scale - 1):
            grams = mix(grams[:-k] * np.uint64(0x9E3779B97F4A7C15) + grams[k:])
            k *= 2
        found: list[tuple[int, int, int]] = []
        places = _minimizers(grams, noted, k, (1 << (scale - 2)) + 1)
        at, lag = _pairs(grams, places, 1 << scale, 2 << scale)
        likely = _likely(words, at, lag)
        at, lag = at[likely], lag[likely]
        order = np.lexsort((at, lag))
        done_lag, done_end = 0, 0
        for a, d in zip(at[order].tolist(), lag[order].tolist()):
            if d == done_lag and a + d < done_end:
                continue
            start, end = _extended(words, a, d)
            done_lag, done_end = d, end
            if end - start >= max(least, 3 * d) and _smallest(words, start, end, d):
                found.append((start, end, d))
        noted += found
        scale += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    for start, end, period in noted:
        if end - start >= max(least, 3 * period):
            text = int(np.searchsorted(starts, start, side="right")) - 1
            out[text].append((start - int(starts[text]), end - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length over period; of equal ones the first."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut to its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_LONGS = "doc_id n_words n_runs start length period exponent_milli".split()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24) -> DataFrame:
    """Every periodic run of each text, and the text with each run cut to its first period.

    One row per row of ``docs``: doc_id, ``n_words``, ``n_runs``; start, length,
    period and thousandths of length/period of the run that repeats most
    (greatest length/period, then least start, then period; null without runs);
    ``runs`` by start, then period, and the SHA-256 of their lines
    ``start,length,period``; the ``collapsed`` text and its SHA-256: words that
    some run contains after its first period are gone, the others are joined by
    one space. Null and empty texts have no words. Repeated rows and ids, and
    rows without an id, are each looked at alone; other columns play no part.
    """
    schema = pa.schema(
        [(c, pa.int64()) for c in _LONGS]
        + [("runs", pa.list_(_RUN)), ("runs_sha256", pa.string()), ("collapsed", pa.string()), ("collapsed_sha256", pa.string())]
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column("text")
            hashes, counts = column_words(texts, lower=False)
            rows = []
            for doc, text, n, runs in zip(batch.column("doc_id").to_pylist(), texts, counts.tolist(), find_runs(hashes, counts, least)):
                words = (text.as_py() or "").encode().split()  # at ASCII white space
                if runs:
                    words = [words[i] for i in np.flatnonzero(_kept(n, runs))]
                best = _highest(runs) if runs else (None, None, None)
                milli = 1000 * best[1] // best[2] if runs else None
                lines = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
                listed = [dict(zip(("start", "length", "period"), run)) for run in runs]
                left = b" ".join(words)
                rows.append(
                    (doc, n, len(runs), *best, milli, listed, sha256(lines.encode()).hexdigest(), left.decode(), sha256(left).hexdigest())
                )
            yield batch_of(schema, list(zip(*rows)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = "runs array<struct<start: long, length: long, period: long>>"
    return rows.mapInArrow(
        look, ", ".join(f"{c} long" for c in _LONGS) + f", {runs}, runs_sha256 string, collapsed string, collapsed_sha256 string"
    )


def planted(doc_id: Column, text: Column) -> Column:
    """The text; for one id in ten, its words from some place on repeat a shorter stretch of them.

    With h the CRC-32 of the decimal id and g = h div 10, texts with h mod 10 = 0
    repeat from word a = g mod n on with period 1 + (n - a) div (3 + g mod 8).
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def again(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        return F.transform(ws, lambda w, i: F.when(i >= a, F.get(ws, (a + (i - a) % p).cast("int"))).otherwise(w))

    # the words are bound by an outer lambda, so that they are found once a text and not once a word
    bound = F.get(F.transform(F.array(words), again), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.array_join(bound, " ")).otherwise(text)
