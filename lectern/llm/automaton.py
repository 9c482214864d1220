"""Removal of repeated word windows with suffix automata.

A suffix automaton of reference text gives, while a document streams past it, the longest suffix of what was read that
occurs in the reference (matching statistics). A window of `size` words repeats where that length reaches `size`.

The reference is the corpus itself, far too large to broadcast, and each document would have to pass each shard. So
the shards are routed, not broadcast: winnowing (repeats.py) deals segments of text out by a hash such that equal
windows meet in one shard, one segment for each class of equal ones. A shard's automaton grows by one class at a time
in the order of their first places. A class streams past what came before it, which gives the windows of its first
occurrence that repeat; if it occurs more often, it streams past the automaton again with itself in it, which gives
those of its later occurrences.

Edge cases: null text or fewer words than a window: nothing is removed; rows with one doc_id are documents of their
own, in the order in which they are read, and rows with a null doc_id come after all others; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import U64, groups, pieces, word_ids
from .repeats import RANGE, Repeats, Symbols, batch, covered, merged


class Automaton:
    """Suffix automaton that grows by whole texts; texts are kept apart by symbols that occur once."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0
        self.texts = 0

    def add(self, words: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        self.texts += 1
        last = self.last
        for c in (*words, (self.texts,)):
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p < 0:
                link.append(0)
            else:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link.append(q)
                else:
                    copy = cur + 1
                    link.append(copy)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = copy
            last = cur
        self.last = last

    def matches(self, words: list) -> list[int]:
        """For each word, the length of the longest suffix of the words so far that occurs in the reference."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            else:
                size = 0
            out.append(size)
        return out


def shard(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Ranges of words that repeat in the classes of each shard, which are sorted by f and place."""
    out: list[tuple] = []
    for t in groups(batches, "f"):
        auto = Automaton()
        for f, sh, doc, dup, a, count, body in zip(*(t.column(c).to_pylist() for c in ("f", "sh", "doc", "dup", "a", "c", "body"))):
            words = body.split(b" ")
            found = [(1, auto.matches(words))] if auto.texts else []
            auto.add(words)
            if count > 1:
                found.append((2, auto.matches(words)))
            for which, sizes in found:
                ends = [i - size + 1 for i, m in enumerate(sizes) if m >= size]
                out += [(f, sh, doc, dup, a, which, i, e) for i, e in merged(ends, size)]
        if len(out) > 10_000:
            yield batch(out, RANGE)
            out = []
    if out:
        yield batch(out, RANGE)


def _joined(body: bytes):
    words = body.split(b" ")
    return lambda i, j: b" ".join(words[max(0, i) : j])


def _body(text: str):
    words = text.encode().split()  # white space of bytes: space and 0x09 to 0x0D
    return lambda i, j: b" ".join(words[i:j])


def word_symbols(text: pa.Array) -> Symbols:
    """Words between ASCII white space; parts are joined by one space."""
    offsets, index, words = word_ids(text)
    known = np.fromiter(map(xxhash.xxh64_intdigest, pc.cast(words, pa.binary()).to_pylist()), U64, len(words))

    @cache
    def laid() -> tuple[memoryview, np.ndarray]:
        flat = words.take(pa.array(index))
        at = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")
        return memoryview(line.buffers()[2] or b""), at

    def parts(i: np.ndarray, j: np.ndarray) -> list[memoryview]:
        data, at = laid()
        return [data[a:b] for a, b in zip(at[i].tolist(), (at[j] - 1).tolist())]

    return Symbols(offsets, known[index] if len(index) else np.zeros(0, U64), parts)


def plan(size: int = 20, k: int = 6, step: int = 4, most: int = 512) -> Repeats:
    return Repeats(word_symbols, _body, _joined, partial(shard, size=size), size, k, (step, 1), most)


def remove_repeats(docs: DataFrame, size: int = 20, k: int = 6, step: int = 4, most: int = 512) -> DataFrame:
    """(doc_id, text, n_words, n_removed): documents without the words of any window that starts earlier elsewhere.

    Words lie between ASCII white space; the words that stay are joined by one space.
    """

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            offsets, index, words = word_ids(b.column("text"))
            text, gone = [], []
            for i, spans in enumerate(b.column("spans").to_pylist()):
                mask, _ = covered(spans, int(offsets[i + 1] - offsets[i]))
                text.append(~mask)
                gone.append(int(mask.sum()))
            keep = np.concatenate(text)
            kept = words.take(pa.array(index[keep]))
            ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), kept), " ")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), joined, pa.array(np.diff(offsets)), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return plan(size, k, step, most).marked(docs).mapInArrow(rebuild, "doc_id long, text string, n_words long, n_removed long")
