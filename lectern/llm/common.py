"""Helpers shared by the corpus operators: shared storage, Arrow batches, word and window hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped
from ..session import kept as saved

U64 = np.uint64
#: Odd multipliers of the 64-bit finaliser.
MIX_A, MIX_B = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
#: Base of the polynomial hash of windows, modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
#: Symbols hashed at once; window positions fit into POS_BITS bits.
POS_BITS = 20
CHUNK = 1 << POS_BITS


# --- shared storage -------------------------------------------------------------------------

def columns(docs: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, whatever else the table has."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def unused(df: DataFrame, name: str) -> str:
    """name, or if df has such a column, name with as many underscores behind it as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- Arrow ----------------------------------------------------------------------------------

def released() -> None:
    """Gives memory that was freed back to the system; Python workers outlive their tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about `limit` bytes in column `text`; a longer text is a slice of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)
    released()


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of rows with equal integer keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if last is not None and tuple(c[0] for c in cols) != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:-1]):
            held.append(b.slice(i, j - i))
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cuts[-2], b.num_rows - cuts[-2]))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
        held = []
    released()


# --- hashes ---------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection. Works in place on a fresh array."""
    x = x ^ (x >> U64(33))
    x *= MIX_A
    x ^= x >> U64(33)
    x *= MIX_B
    x ^= x >> U64(33)
    return x


def word_ids(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space (space, tab to CR): offsets by document, index of each word, distinct words."""
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by document and a 64-bit hash of each word."""
    offsets, index, words = word_ids(text, lower)
    known = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), U64, len(words))
    return offsets, (known[index] if len(index) else np.zeros(0, U64))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _powers:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(CHUNK + 1, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[0] = tuple(out)
    return _powers[0]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by running minima from both ends of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    block = padded.reshape(-1, w)
    head = np.minimum.accumulate(block, axis=1).ravel()
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def chunks(offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of at most CHUNK symbols over documents that lie one after the other.

    Gives first and last symbol, the documents in the range, and where each begins there. A longer document is cut
    into ranges that overlap by `overlap` symbols, so that each window lies in one range.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        if offsets[j] - offsets[i] <= CHUNK:
            yield int(offsets[i]), int(offsets[j]), np.arange(i, j), offsets[i:j] - offsets[i]
        else:
            at, end = int(offsets[i]), int(offsets[i + 1])
            while True:
                to = min(at + CHUNK, end)
                yield at, to, np.array([i]), np.array([0])
                if to == end:
                    break
                at = to - overlap
        i = j


def segments(sym: np.ndarray, starts: np.ndarray, k: int, size: int) -> dict[str, np.ndarray]:
    """Winnowing: groups the windows of `size` symbols by the smallest hash of k symbols that they hold.

    sym: 64-bit hashes of the symbols of one chunk; starts: where its documents begin. A segment is a run of windows
    that share the occurrence of their smallest k-gram. Equal windows anywhere have equal k-grams at equal places, so
    they lie in segments of equal `f`. Gives first window, number of windows, and the k-gram's place rel in it and hash f.
    """
    n = len(sym)
    empty = {c: np.zeros(0, np.int64) for c in ("a", "n", "rel", "f")}
    if n < size:
        return empty
    p, q = powers()
    h = np.zeros(n + 1, U64)
    np.cumsum(sym * p[:n], out=h[1:])
    g = h[k:] - h[:-k]
    g *= q[: n - k + 1]
    g = mix(g)
    key = (g & ~U64(CHUNK - 1)) | np.arange(n - k + 1, dtype=U64)
    low = (sliding_min(key, size - k + 1) & U64(CHUNK - 1)).astype(np.int64)
    valid = np.ones(n - size + 1, bool)
    ends = np.append(starts[1:], n)
    for d in range(len(starts)):  # windows that would cross into the next document
        valid[max(starts[d], ends[d] - size + 1) : ends[d]] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    if not len(a):
        return empty
    at = low[a]
    return {"a": a, "n": b - a + 1, "rel": at - a, "f": g[at].view(np.int64)}


class Forest:
    """Union-find over integers with the smallest member as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (y := up.get(r, r)) != r:
            r = y
        while (y := up.get(x, x)) != r:
            up[x] = r
            x = y
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True
