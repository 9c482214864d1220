"""Dealing out repeated windows to shards, shared by the word-level and the byte-level removal of repeats.

A shard must see all equal windows, and no task may see the whole corpus. So windows of `size` symbols are grouped into
segments by winnowing (common.segments): equal windows lie in segments of equal key f, at equal places. Then:

1. Segments whose f occurs once are dropped; no window of theirs repeats. Of the others, those with equal symbols are one
   class, with a count and its first place; equal means equal length, place and 128-bit BLAKE2b digest of all symbols.
2. The first segment of each class is fetched from its document. The classes of one f are a shard, and the caller's
   kernel tells, by comparing symbols, which windows of each class repeat: in its first occurrence and in later ones.
3. An f with more than `most` classes (the edge of a passage that very many contexts share) is dealt out anew: its classes
   are cut into runs of a few windows that share a core, whose key is made of the core, and what is still too crowded
   into single windows. Classes, shards and kernel are the same there; results pass from runs to their classes.
4. Each occurrence takes its class's ranges.

So each class, the most frequent ones too, is decided by the kernel, and a shard has a bounded number of classes.
Nothing is collected to the driver, and no window is left out.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns, dropped, pieces, saved, segments


class Symbols(NamedTuple):
    """Texts as symbols: offsets by text, a 64-bit hash of each symbol, and parts(i, j): for each i and j in two arrays,
    the bytes of symbols i to j - 1."""

    offsets: np.ndarray
    hashes: np.ndarray
    parts: Callable[[np.ndarray, np.ndarray], list[memoryview]]


PLACE = ("doc", "dup", "a")
_HEAD = struct.Struct("<qq")
CLASS = {"f": "long", "sh": "binary", "doc": "long", "dup": "long", "a": "long", "n": "int", "rel": "int", "c": "long", "body": "binary"}
CHILD = CLASS | {"pf": "long", "psh": "binary", "pdoc": "long", "pdup": "long", "pa": "long"}
#: which: occurrences that a range is for: 0 all, 1 the first, 2 the others; i and e count from the first symbol.
RANGE = {"f": "long", "sh": "binary", "doc": "long", "dup": "long", "a": "long", "which": "int", "i": "long", "e": "long"}
KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def ddl(schema: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in schema.items())


def batch(rows: list[tuple], schema: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[t]) for c, t in zip(zip(*rows), schema.values())], names=list(schema))


def digest(rel: int, n: int, body: bytes | memoryview) -> bytes:
    """128 bits of BLAKE2b over a segment's symbols, its number of windows and its k-gram's place."""
    return blake2b(body, digest_size=16, salt=_HEAD.pack(rel, n)).digest()


def merged(windows: list[int], size: int) -> list[tuple[int, int]]:
    """Ranges of symbols that sorted windows cover."""
    out: list[list[int]] = []
    for i in windows:
        if out and i <= out[-1][1]:
            out[-1][1] = i + size
        else:
            out.append([i, i + size])
    return [tuple(x) for x in out]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, dup, doc_id, text): rows with a key of their own. Rows whose doc_id repeats or is null get a number, and a
    null doc_id comes after all others."""
    own = columns(docs, "doc_id", "text")
    odd = saved(own.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 or doc_id is null").select(F.col("doc_id").alias("odd")), "odd")
    calm = own.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("dup"), "doc_id", "text")
    if odd.isEmpty():
        return calm
    number = F.monotonically_increasing_id() + 1
    some = own.join(odd, F.expr("doc_id <=> odd"), "left_semi").select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), number.alias("dup"), "doc_id", "text")
    return calm.join(odd, F.expr("doc_id <=> odd"), "left_anti").union(saved(some, "numbered"))


@dataclass(frozen=True)
class Repeats:
    """What a caller fixes.

    symbols: splits texts; body(text): a function (first, last symbol) -> bytes of that part, and joined(bytes) the
    same for such bytes; kernel: from classes (CLASS) sorted by f and place, the ranges (RANGE) that repeat in them;
    size: symbols of a window; k: symbols of the k-gram that groups windows; steps: windows of a run, by level; most:
    classes of a shard.
    """

    symbols: Callable[[pa.Array], Symbols]
    body: Callable[[str], Callable[[int, int], bytes]]
    joined: Callable[[bytes], Callable[[int, int], bytes]]
    kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    size: int
    k: int
    steps: tuple[int, ...]
    most: int

    def occurrences(self, rows: DataFrame) -> DataFrame:
        """All segments of all documents: place, number of windows, the k-gram's place in it, key, digest."""
        symbols, size, k = self.symbols, self.size, self.k

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "text"):
                docs, dups = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "dup"))
                s = symbols(b.column("text"))
                for lo, hi, own, starts in chunks(s.offsets, size - 1):
                    x = segments(s.hashes[lo:hi], starts, k, size)
                    if not len(x["a"]):
                        continue
                    d = own[np.searchsorted(starts, x["a"], "right") - 1]
                    first = x["a"] + lo
                    cols = [pa.array(docs[d]), pa.array(dups[d]), pa.array(first - s.offsets[d]), pa.array(x["n"].astype(np.int32)), pa.array(x["rel"].astype(np.int32)), pa.array(x["f"])]
                    bodies = s.parts(first, first + x["n"] + (size - 1))
                    cols.append(pa.array(list(map(digest, x["rel"].tolist(), x["n"].tolist(), bodies)), pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc", "dup", "a", "n", "rel", "f", "sh"])

        return rows.filter("text is not null").select("doc", "dup", "text").mapInArrow(emit, "doc long, dup long, a long, n int, rel int, f long, sh binary")

    def fetch(self, rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """wanted classes with their bodies."""
        body, size = self.body, self.size
        names = [c for c in CLASS if c not in ("doc", "dup", "body")]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, "text", 4 << 20):
                out: list[tuple] = []
                for doc, dup, text, segs in zip(*(b.column(c).to_pylist() for c in ("doc", "dup", "text", "segs"))):
                    part = body(text)
                    out += [(s["f"], s["sh"], doc, dup, s["a"], s["n"], s["rel"], s["c"], part(s["a"], s["a"] + s["n"] + size - 1)) for s in segs]
                if out:
                    yield batch(out, CLASS)

        lists = wanted.groupBy("doc", "dup").agg(F.collect_list(F.struct(*names)).alias("segs"))
        return rows.select("doc", "dup", "text").join(lists, ["doc", "dup"]).mapInArrow(cut, ddl(CLASS))

    def split(self, classes: DataFrame, step: int) -> DataFrame:
        """Classes cut into runs of at most `step` windows at fixed distances from their k-gram.

        All windows of a run share its core, so equal windows lie in runs of equal key, made of the class's key, the
        distance and the core.
        """
        size, joined = self.size, self.joined

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for f, sh, doc, dup, a, n, rel, c, body in zip(*(b.column(x).to_pylist() for x in CLASS)):
                    part = joined(body)
                    i = 0
                    while i < n:
                        # windows i to j - 1; their distance to the k-gram is rel - i and falls to the next multiple of step
                        j = min(n, i + (rel - i) % step + 1)
                        to = i + (rel - i) % step  # the last start that a run of this place can have
                        core = part(to, to - step + 1 + size) if size >= step else b""
                        own = part(i, j - 1 + size)
                        key = xxhash.xxh64_intdigest(b"%d,%d:" % (f, (rel - i) // step) + core) - (1 << 63)
                        out.append((key, digest(rel - i, j - i, own), doc, dup, a + i, j - i, rel - i, c, own, f, sh, doc, dup, a))
                        i = j
                if out:
                    yield batch(out, CHILD)

        return classes.mapInArrow(cut, ddl(CHILD))

    def ranges(self, classes: DataFrame, level: int = 0) -> DataFrame:
        """The ranges that repeat in classes of equal f."""
        def sharded(some: DataFrame) -> DataFrame:
            return some.repartition("f").sortWithinPartitions("f", *PLACE).mapInArrow(self.kernel, ddl(RANGE))

        if level == len(self.steps):
            return sharded(classes)
        crowded = saved(classes.groupBy("f").agg(F.count("*").alias("classes")).filter(F.col("classes") > self.most).select("f"), "crowded")
        if crowded.isEmpty():
            return sharded(classes)
        found = sharded(classes.join(crowded, "f", "left_anti").select(*CLASS))
        runs = saved(self.split(classes.join(crowded, "f", "left_semi").select(*CLASS), self.steps[level]), "runs")
        fields = [c for c in CLASS if c not in ("f", "sh", "c")]
        own = saved(runs.groupBy("f", "sh").agg(F.min(F.struct(*fields)).alias("first"), F.sum("c").alias("c")).select("f", "sh", "first.*", "c").select(*CLASS), "classes")
        inner = saved(self.ranges(own, level + 1), "ranges").withColumnsRenamed({c: f"_{c}" for c in PLACE})
        first = F.expr(" and ".join(f"{c} = _{c}" for c in PLACE))
        # a run that isn't its class's first is a later one in each occurrence of the class that it was cut from
        back = runs.drop("n", "rel", "c", "body").join(inner, ["f", "sh"]).filter(first | (F.col("which") != 1))
        at = F.col("a") - F.col("pa")
        back = back.select(F.col("pf").alias("f"), F.col("psh").alias("sh"), *[F.col(f"p{c}").alias(c) for c in PLACE], F.when(first, F.col("which")).otherwise(0).alias("which"), (at + F.col("i")).alias("i"), (at + F.col("e")).alias("e"))
        return found.union(back)

    def spans(self, rows: DataFrame) -> DataFrame:
        """(doc, dup, a, e): ranges of symbols, maybe overlapping, that repeated windows cover."""
        # as a table of its own, so that the join is one of plain exchanges, whose hot keys Spark can split
        every = saved(self.occurrences(rows), "segments")
        often = saved(every.groupBy("f").agg(F.count("*").alias("c")).filter("c > 1").select("f"), "often")
        occ = saved(every.join(often, "f").select("f", "sh", *PLACE, "n", "rel"), "occurrences")
        dropped(every, often)
        classes = occ.groupBy("f", "sh").agg(F.min(F.struct(*PLACE, "n", "rel")).alias("first"), F.count("*").alias("c")).select("f", "sh", "first.*", "c")
        classes = saved(self.fetch(rows, classes), "classes")
        found = saved(self.ranges(classes), "ranges")
        dropped(classes)
        found = found.withColumnsRenamed({c: f"_{c}" for c in PLACE})
        first = F.expr(" and ".join(f"{c} = _{c}" for c in PLACE))
        mine = occ.drop("n", "rel").join(found, ["f", "sh"]).filter((F.col("which") == 0) | ((F.col("which") == 1) == first))
        spans = saved(mine.select("doc", "dup", (F.col("a") + F.col("i")).alias("b"), (F.col("a") + F.col("e")).alias("e")).withColumnRenamed("b", "a"), "spans")
        dropped(occ, found)
        return spans

    def marked(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, spans): the documents with ranges (a, e) that repeat; null where nothing does."""
        rows = keyed(docs)
        lists = self.spans(rows).groupBy("doc", "dup").agg(F.collect_list(F.struct("a", "e")).alias("spans"))
        return rows.join(lists, ["doc", "dup"], "left").select("doc_id", "text", "spans")


def covered(spans: list[dict] | None, n: int) -> tuple[np.ndarray, int]:
    """Which of n symbols the ranges cover, and in how many maximal runs."""
    if not spans:
        return np.zeros(n, bool), 0
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, [s["a"] for s in spans], 1)
    np.add.at(step, [s["e"] for s in spans], -1)
    mask = np.cumsum(step[:n]) > 0
    runs = int(mask[:1].sum() + np.count_nonzero(mask[1:] & ~mask[:-1]))
    return mask, runs
