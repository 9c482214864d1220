"""Removal of repeated byte strings with suffix arrays built by linear grouping.

suffix_array() sorts suffixes without recursion or renaming: suffixes start in groups by their first symbol; groups
are processed in descending order, and the suffixes that the previous-smaller pointers of a group's members meet move
into groups of their own, by how many pointers meet there, so that each group ends up holding the suffixes with one
Lyndon prefix; a second pass over the groups in ascending order emits each group's order.

suffix_arrays() does the same for many strings at once: each step takes the next group, or the next suffix, of all of
them, so that short strings share their steps.

The corpus is dealt out by winnowing (repeats.py) such that equal windows meet in one shard, one segment for each class
of equal ones. A shard's array is built over its classes. Equal windows are neighbours in it; a window repeats if its
classes occur more than once together.

Edge cases: null text or fewer bytes than a window: nothing is removed; rows with one doc_id, or with none, are
documents of their own; extra columns are ignored; an empty table gives an empty result. What stays of a text may no
longer be valid UTF-8, so it is returned as binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import U64, groups, mix, pieces
from .repeats import RANGE, Repeats, Symbols, batch, covered

#: Strings that are sorted in step, unless the longest has more than 1 / ALONE of their symbols.
TOGETHER, ALONE = 1024, 20
#: A random 64-bit value for each byte.
TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of a sequence of non-negative integers, in linear expected time."""
    s = [*(x + 1 for x in s), 0]
    n = len(s)
    members: dict[int, list[int]] = {}
    by: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by.setdefault(c, []).append(i)
    group = [0] * n  # a group's name is the rank of its first suffix
    size: dict[int, int] = {}
    start_of_end: dict[int, int] = {}
    at = 0
    for c in sorted(by):
        m = by[c]
        for i in m:
            group[i] = at
        members[at], size[at] = m, len(m)
        start_of_end[at + len(m)] = at
        at += len(m)
    before = [-1] * n
    end = n
    while end > 0:
        g = start_of_end[end]
        hits: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:
                continue  # has moved on
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            split: dict[int, dict[int, list[int]]] = {}
            for j, times in hits.items():
                split.setdefault(times, {}).setdefault(group[j], []).append(j)
            for times in sorted(split, reverse=True):
                for old, moved in split[times].items():
                    rest = size[old] - len(moved)
                    if rest:
                        new = old + rest
                        start_of_end[old + size[old]], start_of_end[new] = new, old
                        size[old], size[new] = rest, len(moved)
                        moved.sort()
                        members[new] = moved
                        for j in moved:
                            group[j] = new
        end = g
    out = [0] * n
    free = list(range(n))
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return out[1:]


def suffix_arrays(s: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Suffix arrays, one after the other, of strings that lie one after the other and each end in a 0 of their own.

    start: where they begin, and the end. Works as suffix_array(), on all strings in step.
    """
    n, k = len(s), len(start) - 1
    string = np.repeat(np.arange(k), np.diff(start))
    at = np.lexsort((s, string))  # by slot: the suffix there; a group is a range of slots, named by its first
    slot = np.empty(n, np.int64)
    slot[at] = np.arange(n)
    heads = np.flatnonzero(np.r_[True, (s[at][1:] != s[at][:-1]) | (string[at][1:] != string[at][:-1])])
    length = np.diff(np.append(heads, n))
    group, size, opens = np.empty(n, np.int64), np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
    group[at] = np.repeat(heads, length)
    size[heads] = length
    opens[heads + length] = heads  # by end: where the group begins
    before, moves = np.full(n, -1), np.zeros(n, bool)
    end, live = start[1:].copy(), np.arange(k)
    while len(live):
        g = opens[end[live]]
        count = end[live] - g
        of = np.repeat(np.arange(len(live)), count)
        i = at[np.arange(len(of)) + np.repeat(g - np.cumsum(count) + count, count)]
        least, first = g[of], start[live][of]
        j = i - 1
        busy = np.flatnonzero(j >= first)
        while len(busy := busy[group[j[busy]] > least[busy]]):
            j[busy] = before[j[busy]]
            busy = busy[j[busy] >= first[busy]]
        before[i] = j
        # pointers that end within the group go on from there
        busy = np.flatnonzero(j >= first)
        while len(busy := busy[group[j[busy]] == least[busy]]):
            j[busy] = before[j[busy]]
            before[i[busy]] = j[busy]
            busy = busy[j[busy] >= first[busy]]
        hit, times = np.unique(j[j >= first], return_counts=True)
        if len(hit):
            old = group[hit]
            order = np.lexsort((hit, times, old))
            hit, times, old = hit[order], times[order], old[order]
            new = np.r_[True, old[1:] != old[:-1]]
            head = np.flatnonzero(new)
            moved = np.diff(np.append(head, len(hit)))
            names = old[head]
            base = names + size[names] - moved  # those that move take their group's last slots, by how many met there
            target = np.repeat(base - head, moved) + np.arange(len(hit))
            moves[hit] = True
            there, left = at[target], slot[hit]
            there, left = there[~moves[there]], left[left < np.repeat(base, moved)]
            at[left], slot[there] = there, left
            at[target], slot[hit] = hit, target
            moves[hit] = False
            run = np.flatnonzero(new | np.r_[True, times[1:] != times[:-1]])
            length = np.diff(np.append(run, len(hit)))
            group[hit] = np.repeat(target[run], length)
            size[target[run]] = length
            opens[target[run] + length] = target[run]
            rest = base > names
            size[names[rest]] = (base - names)[rest]
            opens[base[rest]] = names[rest]
        end[live] = g
        live = live[g > start[live]]
    # each group's order, by the suffixes that are placed already
    by_length = np.argsort(-np.diff(start), kind="stable")
    first, length = start[:-1][by_length], np.diff(start)[by_length]
    out, free, placed = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
    out[first] = first + length - 1
    placed[out[first]] = True
    for r in range(int(length[0]) if k else 0):
        lowest = first[: np.searchsorted(-length, -r, "left")]
        j = out[lowest + r] - 1
        while True:
            going = j >= lowest
            going[going] = ~placed[j[going]]
            j, lowest = j[going], lowest[going]
            if not len(j):
                break
            to = free[group[j]]
            out[to] = j
            free[group[j]] = to + 1
            placed[j] = True
            j = before[j]
    return out


def sorted_suffixes(s: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings as suffix_arrays() gives them; a string that is long for its neighbours is sorted alone."""
    length = np.diff(start)
    out, held = np.zeros(len(s), np.int64), 0
    order = np.argsort(length, kind="stable")
    while held < len(order):
        some = order[held : held + TOGETHER]
        held += len(some)
        if length[some].sum() < ALONE * length[some].max():
            for x in some:
                a, b = start[x], start[x + 1]
                out[a:b] = a + np.array([b - a - 1, *suffix_array((s[a : b - 1] - 1).tolist())])
            continue
        n = length[some]
        flat = np.arange(n.sum()) + np.repeat(start[some] - np.cumsum(n) + n, n)
        out[flat] = flat[suffix_arrays(s[flat], np.concatenate([[0], np.cumsum(n)]))]
    return out


def same(data: np.ndarray, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Whether the `size` bytes from i equal those from j, eight at a time."""
    eight = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    out = np.ones(len(i), bool)
    for at in [*range(0, size - 7, 8), size - 8]:
        left = np.flatnonzero(out)
        out[left] = eight[i[left] + at] == eight[j[left] + at]
    return out


def repeated(bodies: list[bytes], shard: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(body, place) of each window of `size` >= 8 bytes that occurs more than once in the bodies of its shard.

    shard: by body, ascending from 0; counts: how often each body occurs.
    """
    length = np.fromiter(map(len, bodies), np.int64, len(bodies))
    data = np.frombuffer(b"".join(bodies), np.uint8)
    n, many = len(data), np.bincount(shard)
    own = np.arange(len(bodies)) - np.repeat(np.cumsum(many) - many, many)  # a body's number in its shard
    # a string for each shard: bodies that each end in a symbol of their own, and a 0
    ends = np.cumsum(length + 1 + np.r_[shard[1:] != shard[:-1], True])
    first = ends - length - 1 - np.r_[shard[1:] != shard[:-1], True]
    s, of = np.zeros(ends[-1], np.int64), np.full(ends[-1], -1)
    body = np.repeat(np.arange(len(bodies)), length)
    byte = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
    s[first[body] + byte] = data.astype(np.int64) + np.repeat(many[shard] + 1, length)
    s[first + length] = own + 1
    of[first[body] + byte] = np.arange(n)
    order = of[sorted_suffixes(s, np.append(first[own == 0], ends[-1]))]
    order = order[order >= 0]
    order = order[byte[order] + size <= length[body[order]]]  # whole windows only; those of one shard lie together
    if not len(order):
        return order, order
    new = np.r_[True, (shard[body[order[1:]]] != shard[body[order[:-1]]]) | ~same(data, order[1:], order[:-1], size)]
    times = np.add.reduceat(counts[body[order]], np.flatnonzero(new))
    some = np.sort(order[times[np.cumsum(new) - 1] > 1])
    return body[some], byte[some]


def shard(batches: Iterator[pa.RecordBatch], size: int, upto: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Ranges of bytes that repeat in the classes of each shard, which are sorted by f; shards of about `upto` bytes are
    worked on at once. The windows of one class differ, so a class that is alone in its shard needs no array: it
    repeats where it occurs more than once."""
    rows: list[tuple] = []  # of shards with several classes
    of: list[int] = []
    alone: list[tuple] = []
    held = shards = 0

    def done() -> Iterator[pa.RecordBatch]:
        out = [(*r[:5], 0, 0, len(r[-1])) for r in alone]
        if rows:
            body, place = repeated([r[-1] for r in rows], np.array(of), np.array([r[-2] for r in rows]), size)
            new = (body[1:] != body[:-1]) | (place[1:] > place[:-1] + size)
            first, last = np.r_[True, new][: len(body)], np.r_[new, True][: len(body)]
            out += [(*rows[b][:5], 0, i, e) for b, i, e in zip(body[first].tolist(), place[first].tolist(), (place[last] + size).tolist())]
        if out:
            yield batch(out, RANGE)

    for t in groups(batches, "f"):
        some = list(zip(*(t.column(c).to_pylist() for c in ("f", "sh", "doc", "dup", "a", "c", "body"))))
        if len(some) == 1:
            alone += [r for r in some if r[-2] > 1]
        else:
            rows += some
            of += [shards] * len(some)
            shards += 1
            held += sum(len(r[-1]) for r in some)
        if held >= upto or len(alone) > 20_000:
            yield from done()
            rows, of, alone, held, shards = [], [], [], 0, 0
    yield from done()


def byte_symbols(text: pa.Array) -> Symbols:
    """Bytes, and a 64-bit value of each."""
    text = pc.cast(pc.fill_null(text, ""), pa.large_binary())
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    raw = memoryview(data)
    return Symbols(offsets - offsets[0], TABLE[data], lambda i, j: [raw[a:b] for a, b in zip(i.tolist(), j.tolist())])


def _joined(body: bytes):
    return lambda i, j: body[max(0, i) : j]


def _body(text: str):
    return _joined(text.encode())


def plan(size: int = 200, k: int = 64, step: int = 16, most: int = 1024) -> Repeats:
    return Repeats(byte_symbols, _body, _joined, partial(shard, size=size), size, k, (step, 1), most)


def remove_repeats(docs: DataFrame, size: int = 200, k: int = 64, step: int = 16, most: int = 1024) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans): UTF-8 texts without any string of `size` bytes that occurs twice."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            rows = []
            for text, spans in zip(pc.fill_null(b.column("text"), "").to_pylist(), b.column("spans").to_pylist()):
                data = text.encode()
                if spans:
                    mask, runs = covered(spans, len(data))
                    rows.append((np.frombuffer(data, np.uint8)[~mask].tobytes(), len(data), int(mask.sum()), runs))
                else:
                    rows.append((data, len(data), 0, 0))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return plan(size, k, step, most).marked(docs).mapInArrow(rebuild, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
