"""Periodic runs of words by bit-parallel lags.

The words of a text are numbered; bit b of all numbers is one big integer, a plane, with a bit for each word. For a lag q

    mismatch = OR over planes of (plane XOR (plane >> q))

has a zero where the words q apart are identical. A run of period q and length >= max(6, 4 q) is a stretch of at least
max(6, 4 q) - q zeros: the complement is ANDed with itself shifted by 1, 2, 4, ... until each bit that is left begins
such a stretch. Most lags are done after a plane or two, as the AND is empty. Lags are tried in ascending order; a
stretch that a smaller lag has found already has that smaller period (any period of a stretch of four periods is a
multiple of the smallest one), so it's left out.

Lags are n / 4 and planes grow with n, so in texts of more than ALL_LAGS words only lags that can hold a run are tried.
Within a run of smallest period q <= Q the next occurrence of Q equal words is exactly q words on, as no shift below
its period maps a run onto itself; so q is the gap of at least q + 1 such places for the power of two Q from q on.
Equal stretches of Q words are numbered by doubling, without hashes. No run is lost; the planes decide each lag as before.

Edge cases: null and empty texts have no words and no runs; words are what lies between ASCII white space; a text is
processed whole, however long; rows that share a doc_id, or have none, are rows of their own; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, pieces, word_ids

#: Longest text, in words, in which every lag up to a quarter of it is tried.
ALL_LAGS = 1 << 13
#: Planes that are compared before it is looked whether a stretch can be left; all of them in the end.
LOOKS = (1, 2, 4, 8)
FOUND = "doc_id long, runs array<struct<start:long,length:long,period:long>>, kept array<string>"


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of all ids as a big integer, for each b."""
    return [int.from_bytes(np.packbits((ids >> b) & 1 == 1, bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]


def long_stretches(same: int, need: int) -> int:
    """Bits that begin a stretch of `need` ones."""
    have = 1
    while same and have < need:
        step = min(have, need - have)
        same &= same >> step
        have += step
    return same


def matches(bits: list[int], n: int, q: int, need: int) -> int:
    """Places from which on at least `need` words equal those q further on."""
    valid, mismatch, begins = (1 << (n - q)) - 1, 0, 0
    for i, p in enumerate(bits, 1):
        mismatch |= p ^ (p >> q)
        if i in LOOKS or i == len(bits):
            begins = long_stretches(valid & ~mismatch, need)
            if not begins:
                return 0
    return begins


def likely_lags(ids: np.ndarray) -> list[int]:
    """Lags up to a quarter of a text that can hold a run: those that are the gap to the next equal stretch often enough."""
    n = len(ids)
    name = np.unique(ids, return_inverse=True)[1].astype(np.int64)  # of the stretch of `size` words from each place on
    size, out = 1, []
    while len(name) and (size // 2 + 1) * 4 <= n:
        order = np.argsort(name, kind="stable")
        equal = name[order[1:]] == name[order[:-1]]
        gap = (order[1:] - order[:-1])[equal]
        gap = gap[(gap > size // 2) & (gap <= size)]
        lag, times = np.unique(gap, return_counts=True)
        out += lag[(times > lag) & (4 * lag <= n)].tolist()
        name = np.unique(name[:-size] * np.int64(n + 1) + name[size:], return_inverse=True)[1].astype(np.int64)
        size *= 2
    return sorted(out)


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs of a text whose words have these numbers, by start, then period."""
    n = len(ids)
    if n < 6:
        return []
    bits, found = planes(ids), {}
    for q in range(1, n // 4 + 1) if n <= ALL_LAGS else likely_lags(ids):
        need = max(6, 4 * q) - q
        begins = matches(bits, n, q, need)
        if not begins:
            continue
        at = np.flatnonzero(np.unpackbits(np.frombuffer(begins.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))
        cut = np.flatnonzero(np.diff(at) > 1)
        for first, last in zip(at[np.r_[0, cut + 1]].tolist(), at[np.r_[cut, len(at) - 1]].tolist()):
            found.setdefault((first, last - first + need + q), q)
    return sorted((start, q, length) for (start, length), q in found.items())


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words are kept: those that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, q, length in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def texts_runs(text: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, pa.Array]]:
    """For each text: its runs, which words are kept, and its words."""
    offsets, index, words = word_ids(text)
    for i, j in zip(offsets.tolist(), offsets[1:].tolist()):
        ids = index[i:j].astype(np.int64)
        runs = find_runs(ids)
        yield runs, collapsed(j - i, runs), words.take(pa.array(ids))


def find_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, kept): each text's runs by start and period, and the words that are left when runs collapse to one period."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in pieces(batches, "text", 2 << 20):
            runs, kept = [], []
            for r, keep, words in texts_runs(b.column(1)):
                runs.append([{"start": s, "length": n, "period": q} for s, q, n in r])
                kept.append(words.filter(pa.array(keep)))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, kind), pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(kept))], names=["doc_id", "runs", "kept"])

    return columns(docs, "doc_id", "text").mapInArrow(emit, FOUND)
