"""Packing of token streams into sequences by an order-preserving dynamic program.

The documents of a block, one after the other, are cut into windows of at most `window` tokens. Among the places where
a window may end (ends of documents and sentences, and places in long stretches without either), the program picks
those that minimise padding plus a penalty for each place: none at the end of a document, little at a sentence's, more
inside one. A window ending at j costs window - (j - i), so the best start is the least cost[i] + i in reach, which a
monotone queue gives in constant time. A block's last window is cut into powers of two, which need no padding.

A block is a run of rows of one input partition with about `block_tokens` tokens; no row is moved, so packing follows
the order in which the table is read. Sequence ids are the input partition and a number within it.

Edge cases: null text counts as empty, and an empty document is its end id alone; repeated rows are packed each; a very
long document is cut like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import columns, pieces

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"


class Rules(NamedTuple):
    window: int = 1024
    sentence: int = 2
    inside: int = 12
    stretch: int = 32
    block_tokens: int = 1 << 20


def bpe(path: str, pattern: str):
    """The byte-level BPE of a file of the tokenizers library; strings of special tokens in a text become their ids.

    A vocabulary whose ids follow the order of merges is the same as ranks of byte strings, which tiktoken reads three
    times faster; any other is refused.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab = file["model"]["vocab"]
    # bytes that print stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in file["model"]["merges"]]
    if [vocab[m] for m in merges] != list(range(256, 256 + len(merges))):
        raise ValueError(f"{path}: ids don't follow the order of merges")
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def sentence_ends(encoding) -> np.ndarray:
    """By id: whether a token ends a sentence."""
    out = np.zeros(encoding.max_token_value + 1, bool)
    for i in range(len(out)):
        try:
            out[i] = encoding.decode_single_token_bytes(i).rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n")
        except KeyError:
            pass
    return out


def places(n: int, docs: np.ndarray, sentences: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, from 0 to n, and the penalty of each place."""
    fixed = np.unique(np.concatenate([[0], docs, sentences, [n]]))
    gap = np.diff(fixed)
    long = np.flatnonzero(gap > rules.stretch)
    extra = (gap[long] - 1) // rules.stretch
    number = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    inner = np.repeat(fixed[long], extra) + number * rules.stretch
    at = np.concatenate([fixed, inner])
    cost = np.concatenate([np.full(len(fixed), rules.sentence), np.full(len(inner), rules.inside)])
    cost[: len(fixed)][np.isin(fixed, docs, assume_unique=False)] = 0
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


def cut(at: list[int], cost: list[int], window: int) -> list[int]:
    """Ends of windows up to at[-1], at least padding plus penalties; the last window's padding doesn't count."""
    m = len(at)
    total, back = [0] * m, [0] * m
    queue, value = [0] * m, [0] * m  # candidates for a window's start, by increasing total + place
    head = tail = 0
    for j in range(1, m):
        v = total[j - 1] + at[j - 1]
        while tail > head and value[tail - 1] > v:
            tail -= 1
        queue[tail] = j - 1
        value[tail] = v
        tail += 1
        p = at[j] - window
        while at[queue[head]] < p:
            head += 1
        total[j] = value[head] - p + cost[j]
        back[j] = queue[head]
    last = m - 1
    first = last
    while first > 0 and at[first - 1] >= at[last] - window:
        first -= 1
    out = [at[last]] if last else []
    j = min(range(first, last), key=total.__getitem__) if last else 0
    while j > 0:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def pack_block(ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray, rules: Rules) -> tuple[np.ndarray, ...]:
    """Pieces (document, start in it, length, sequence, offset, start in the block) of one block."""
    n = len(ids)
    docs = np.cumsum(lengths)
    at, cost = places(n, docs, np.flatnonzero(ends[ids]) + 1, rules)
    windows = cut(at.tolist(), cost.tolist(), rules.window)
    begin = windows[-2] if len(windows) > 1 else 0
    rest, tail = n - begin, []
    while rest:  # 700 = 512 + 128 + 32 + 16 + 8 + 4
        part = 1 << (rest.bit_length() - 1)
        begin, rest = begin + part, rest - part
        tail.append(begin)
    stop = np.array([*windows[:-1], *tail], np.int64)
    edge = np.unique(np.concatenate([[0], docs, stop]))
    start, length = edge[:-1], np.diff(edge)
    doc = np.searchsorted(docs, start, "right")
    seq = np.searchsorted(stop, start, "right")
    first = np.concatenate([[0], docs[:-1]])
    return doc, start - first[doc], length, seq, start - np.concatenate([[0], stop[:-1]])[seq], start


def packer(path: str, pattern: str, end_id: int, rules: Rules = Rules()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, np.ndarray]]]:
    """A function from batches (doc_id, text) to columns of pieces, with the ids of the block beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoding = bpe(path, pattern)
        ends = sentence_ends(encoding)
        sequence = TaskContext.get().partitionId() << 40
        names: list = []
        tokens: list[np.ndarray] = []
        held = 0

        def block() -> dict:
            nonlocal sequence
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ids = np.concatenate(tokens)
            doc, start, length, seq, offset, at = pack_block(ids, lengths, ends, rules)
            out = {"doc_id": pa.array(names, pa.int64()).take(pa.array(doc)), "start": start, "length": length, "doc_tokens": lengths[doc], "sequence_id": sequence + seq, "offset": offset, "at": at, "ids": ids}
            sequence += int(seq[-1]) + 1
            return out

        end = np.array([end_id], np.uint32)
        for b in pieces(batches, "text", 4 << 20):
            for name, text in zip(b.column(0).to_pylist(), pc.fill_null(b.column(1), "").to_pylist()):
                names.append(name)
                tokens.append(np.concatenate([encoding.encode_to_numpy(text, allowed_special="all"), end]))
                held += len(tokens[-1])
                if held >= rules.block_tokens:
                    yield block()
                    names, tokens, held = [], [], 0
        if names:
            yield block()

    return run


def pack(docs: DataFrame, path: str, pattern: str, end_id: int = 0, rules: Rules = Rules()) -> DataFrame:
    """Pieces of documents with their ids: which sequence, and where in it."""
    run = packer(path, pattern, end_id, rules)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in run(batches):
            at = np.append(x["at"], len(x["ids"])).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(x["ids"].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([x["doc_id"], *(pa.array(x[c]) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")), ids], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return columns(docs, "doc_id", "text").mapInArrow(emit, PIECES)
