"""Exact duplicates through a log-structured merge index of text digests.

Each task gathers digests in a memtable and flushes it, sorted, as a run of level 0; a flush already combines copies that
met in the memtable. The key space is cut into ranges of the digest's first bits, as many as rows ask for. Compaction goes level by level:
about `fan` runs of a level are merged, range by range, into one run of the next, a merge of sorted rows that keeps the
smallest identifier and adds up the counts, until each range has one run. The last level keeps only the digests of more
than one document; each of its runs has a Bloom filter of its own, and all filters together have a fixed bound (fuller
filters let more digests pass, never fewer).

A lookup goes to the one run whose range a digest lies in, if that run's filter lets it pass, and reads only the runs that
some digest goes to. A document that the filter holds off is alone, so neither its digest nor its text moves; the others
look their digests up, and their normalised texts are compared as bytes. If texts differ under one digest, those
documents are grouped by the texts.

Texts are equal when they are after replacing each run of ASCII white space by one space.

Edge cases: null text counts as empty, and empty texts are copies of each other; a null doc_id counts in its group but
is kept only where the whole group has none; repeated rows (same doc_id) count each and are all kept if their doc_id
is; extra columns are ignored by find_copies() and kept by drop_copies(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, columns, dropped, mix, saved, unused

RUN = "run long, digest binary, doc_id long, n long"
#: Entries of a memtable; bits of the filter for each digest, but at most MOST_BITS (16 MB), and hashes of a digest.
MEMTABLE, FILTER_BITS, MOST_BITS, PROBES = 1 << 16, 10, 1 << 27, 7
#: Bits of a filter that are merged as one row; runs that one of the next level is merged from; rows of runs that a range
#: may have on average, and the least number of ranges.
SEGMENT, FAN, RANGE, RANGES = 1 << 15, 64, 1 << 21, 16
#: In place of a null doc_id where the smallest counts.
NONE = np.iinfo(np.int64).max
MIXED = U64(0x9E3779B97F4A7C15)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column, bits: int = 256) -> Column:
    """SHA-256. bits: keep fewer of them, to test what collisions do."""
    return F.substring(F.unhex(F.sha2(text, 256)), F.lit(1), F.lit(bits // 8))


def digests(docs: DataFrame, bits: int = 256) -> DataFrame:
    """(doc_id, digest) of the normalised texts."""
    return columns(docs, "doc_id", "text").select("doc_id", digest(normalised(F.col("text")), bits).alias("digest"))


def runs(found: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """Sorted runs (run, digest, smallest doc_id, number of documents) of (doc_id, digest)."""

    def flush(table: dict[bytes, list], run: int) -> pa.RecordBatch:
        keys = sorted(table)
        return pa.RecordBatch.from_arrays([pa.array([run] * len(keys), pa.int64()), pa.array(keys, pa.binary()), pa.array([table[k][0] for k in keys], pa.int64()), pa.array([table[k][1] for k in keys], pa.int64())], names=["run", "digest", "doc_id", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 32
        table: dict[bytes, list] = {}
        for b in batches:
            for doc, digest in zip(b.column("doc_id").to_pylist(), b.column("digest").to_pylist()):
                if (have := table.get(digest)) is None:
                    table[digest] = [doc, 1]
                    if len(table) >= memtable:
                        yield flush(table, run)
                        run += 1
                        table = {}
                else:
                    have[1] += 1
                    if doc is not None and (have[0] is None or doc < have[0]):
                        have[0] = doc
        if table:
            yield flush(table, run)

    return found.mapInArrow(gather, RUN)


def shard_of(digest: Column, n: int) -> Column:
    """Which of n ranges a digest lies in, by its first two bytes."""
    return F.floor(F.conv(F.rpad(F.hex(F.substring(digest, 1, 2)), 4, "0"), 16, 10).cast("int") * n / 65536).cast("int")


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, run, digest, doc_id, n) in order, with those of equal digests in a run combined."""
    names = ["shard", "run", "digest", "doc_id", "n"]
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks()
        new = np.ones(t.num_rows, bool)
        for c in names[:3]:
            x = t.column(c)
            differ = pc.not_equal(x.slice(1), x.slice(0, t.num_rows - 1)).to_numpy()
            new[1:] = differ if c == "shard" else new[1:] | differ
        first = np.flatnonzero(new)
        docs = pc.fill_null(t.column("doc_id"), NONE).to_numpy()
        least, n = np.minimum.reduceat(docs, first), np.add.reduceat(t.column("n").to_numpy(), first)
        heads = t.select(names[:3]).take(pa.array(first)).combine_chunks().to_batches()[0]
        out = pa.RecordBatch.from_arrays([*heads.columns, pa.array(least, pa.int64(), mask=least == NONE), pa.array(n, pa.int64())], names=names)
        held = [out.slice(out.num_rows - 1)]
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    yield from held


def ranges(run_table: DataFrame) -> int:
    """How many ranges the rows of runs ask for: a power of two."""
    return min(1 << 16, max(RANGES, 1 << (run_table.count() // RANGE).bit_length()))


def levels(run_table: DataFrame, shards_: int, fan: int = FAN) -> Iterator[DataFrame]:
    """The runs of each level from the first merge on; the last has one run for each range."""
    level = run_table.withColumn("shard", shard_of(F.col("digest"), shards_)).select("shard", "run", "digest", "doc_id", "n")
    runs_ = run_table.select("run").distinct().count()
    while True:
        runs_ = -(-runs_ // fan)
        out = level.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(max(1, runs_))))
        out = out.repartition("shard", "run").sortWithinPartitions("shard", "run", "digest").mapInArrow(merged, "shard int, run long, digest binary, doc_id long, n long")
        if runs_ > 1:
            level = saved(out, "level")
            yield level
        else:
            yield out
            return


def compacted(run_table: DataFrame, shards_: int, fan: int = FAN) -> DataFrame:
    """(digest, keep_id, group_size, shard) of digests with several documents: the last level, a folder for each range."""
    *before, last = levels(run_table, shards_, fan)
    kept = last.filter("n > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), "shard")
    out = saved(kept, "index", "shard")
    dropped(*before)
    return out


class Filter(NamedTuple):
    """Bloom filters of the runs of a level: the bits of one after the other, packed; by range, where its filter begins, how
    many bits it has (0: no run) and how many of them a digest sets."""

    bits: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    probes: np.ndarray

    def may_hold(self, digest: list[bytes | None]) -> np.ndarray:
        """Which digests may be among those that the filters were made of; False is certain."""
        shard = shards(digest, len(self.size))
        out = self.size[shard] > 0
        at, of = places([d for d, some in zip(digest, out) if some], self)
        hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        missed = np.bincount(of, ~hit, int(out.sum())) > 0
        out[np.flatnonzero(out)[missed]] = False
        return out


def shards(digest: list[bytes | None], n: int) -> np.ndarray:
    """Which of n ranges digests lie in."""
    return np.array([int.from_bytes(d[:2].ljust(2, b"\0"), "big") * n // 65536 if d else 0 for d in digest], np.int64)


def places(digest: list[bytes | None], filters: Filter) -> tuple[np.ndarray, np.ndarray]:
    """The bits that digests set, each in the filter of its range, by its first 8 bytes; and whose each is."""
    head = np.frombuffer(b"".join((d or b"")[:8].ljust(8, b"\0") for d in digest), U64)
    shard = shards(digest, len(filters.size))
    n = filters.probes[shard] if len(shard) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(digest)), n)
    i = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)).astype(U64)
    at = (mix(head)[of] + i * mix(head ^ MIXED)[of]) % filters.size[shard[of]].astype(U64)
    return filters.begin[shard[of]] + at.astype(np.int64), of


def filter_of(table: DataFrame, most_bits: int = MOST_BITS, shards_: int = RANGES) -> Filter:
    """The filters of the runs of a saved table, one for each range. Tasks set bits, segments of them are merged, and the
    whole, which is bounded by most_bits and a segment for each range, comes to the driver."""
    own, step = table.select("digest").withColumn("shard", shard_of(F.col("digest"), shards_)), SEGMENT
    count = np.zeros(shards_, np.int64)
    for r in own.groupBy("shard").count().collect():  # at most one for each range
        count[r.shard] = r["count"]
    n = int(count.sum())
    wanted = np.minimum(FILTER_BITS * count, most_bits * count // max(1, n))
    size = -(-wanted // step) * step
    size[(count > 0) & (size == 0)] = step
    probes = np.where(count > 0, np.clip(np.rint(size / np.maximum(1, count) * 0.69), 1, PROBES), 0).astype(np.int64)
    total = int(size.sum())
    empty = Filter(np.zeros(total // 8, np.uint8), np.cumsum(size) - size, size, probes)
    if not n:
        return empty

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(total, bool)
        for b in batches:
            mask[places(b.column(0).to_pylist(), empty)[0]] = True
        parts = mask.reshape(-1, step)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([np.packbits(parts[i]).tobytes() for i in some], pa.binary())], names=["segment", "bits"])

    def merge(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce(np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(t.num_rows, -1))
        return pa.table({"segment": t.column("segment")[:1], "bits": pa.array([both.tobytes()], pa.binary())})

    kind = "segment long, bits binary"
    for r in table.select("digest").mapInArrow(fill, kind).groupBy("segment").applyInArrow(merge, kind).collect():
        empty.bits[r.segment * step // 8 : (r.segment + 1) * step // 8] = np.frombuffer(r.bits, np.uint8)
    return empty


def may_repeat(spark: SparkSession, index: Filter) -> Callable[[str], Column]:
    """A condition on a digest column: whether the filter lets the digest pass."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def passes(digest: pa.Array) -> pa.Array:
        return pa.array(shared.value.may_hold(digest.to_pylist()))

    return passes


def looked_for(index: DataFrame, asked: DataFrame, shards_: int) -> DataFrame:
    """The rows of an index in those of its runs that the digests of `asked` lie in: other runs' files aren't read."""
    wanted = [r.shard for r in asked.select(shard_of(F.col("digest"), shards_).alias("shard")).distinct().collect()]  # at most one for each range
    return index.filter(F.col("shard").isin(wanted)).drop("shard")


def looked_up(docs: DataFrame, bits: int, memtable: int) -> tuple[DataFrame, DataFrame, Callable[[str], Column]]:
    """The rows of find_copies() for documents that the filter holds off, for the others, and the filter's condition."""
    found = saved(digests(docs, bits), "digests")
    flushed = saved(runs(found, memtable), "runs")
    shards_ = ranges(flushed)
    index = compacted(flushed, shards_)
    dropped(flushed)
    passes = may_repeat(docs.sparkSession, filter_of(index, shards_=shards_))
    marked = found.withColumn("maybe", passes("digest"))
    several = looked_for(index, marked.filter("maybe"), shards_)
    alone = marked.filter("not maybe").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    hits = (marked.filter("maybe").join(several, "digest", "left")
            .select("doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")))
    texts = columns(docs, "doc_id", "text").select("doc_id", normalised(F.col("text")).alias("text")).withColumn("digest", digest(F.col("text"), bits))
    wrong = saved(texts.filter(passes("digest")).groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("digest"), "wrong")
    if wrong.isEmpty():
        return alone, hits, passes
    own = texts.join(wrong, "digest", "left_semi")
    exact = own.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    own = own.join(exact, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
    return alone, hits.join(wrong, "digest", "left_anti").select(*own.columns).union(own), passes


def find_copies(docs: DataFrame, bits: int = 256, memtable: int = MEMTABLE) -> DataFrame:
    """(doc_id, digest, keep_id, group_size): for each document the one that stays of its group."""
    alone, hits, _ = looked_up(docs, bits, memtable)
    return hits.union(alone)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text an earlier doc_id has. Only rows that the filter lets pass move."""
    _, hits, passes = looked_up(docs, 256, MEMTABLE)
    of, maybe, keep_of, keep_id = (unused(docs, c) for c in ("digest", "maybe", "keep_of", "keep_id"))
    # as a table of its own, so that the lookup of a hot digest is one of plain exchanges, which Spark can split
    keep = saved(hits.filter("doc_id <=> keep_id").select(F.col("digest").alias(keep_of), F.col("doc_id").alias(keep_id)), "keep").distinct()
    marked = docs.withColumn(of, digest(normalised(F.col("text")))).withColumn(maybe, passes(F.col(f"`{of}`")))
    some = marked.filter(F.col(f"`{maybe}`")).join(keep, F.expr(f"`{of}` = `{keep_of}` AND doc_id <=> `{keep_id}`"), "left_semi")
    return marked.filter(~F.col(f"`{maybe}`")).union(some).drop(of, maybe)
