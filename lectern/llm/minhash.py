"""Near-duplicates by a chosen-path set similarity join on word shingles.

Each document has a sketch of minwise values of its shingle set. In each of several independent trees, a document goes
down from the root: a node picks one or two coordinates by a hash of its path, and the document enters the child named
by each picked coordinate's value. Similar sets enter the same children; all documents in one node of depth `first` are
compared, however many they are.

1. One pass over the texts gives a sketch and a digest of each set; equal sets become one representative.
2. Trees are grown over representatives. Within a node all pairs are compared by their sketches, with a bound that a
   linked pair misses with a chance of about 1e-7; a node larger than `tile` is compared tile by tile. Pairs that are already connected aren't compared again, as only connectivity counts here.
3. The connected pieces of that coarse graph get their full sets, from the texts that a filter of at most 16 MB of their
   documents lets pass, so no other text moves while it isn't full; and within a piece every pair that isn't connected
   yet is confirmed or refused by the exact Jaccard similarity of the whole sets. Components of confirmed links are
   the result.

All trees read one sketch, so their chances to miss a pair aren't independent. By simulation of children() on 200,000
pairs, `trees` = 12 of depth 3 miss 2.5e-5 of the pairs whose coordinates agree with a chance of 0.80, and fewer above it.

Edge cases: null or empty texts have an empty set and link with nothing; a text with fewer words than a shingle is one
shingle; rows that share a doc_id are one document, which links with what any of its texts links with; a null doc_id
links with nothing; extra columns are ignored by find_near() and kept by drop_near(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_B, U64, columns, groups, mix, pieces, saved, word_hashes
from .components import components
from .exact import filter_of, may_repeat

SETS = "doc_id long, n_shingles long, digest binary, sketch binary"
COORDS = 64


class Rules(NamedTuple):
    """shingle: words of a shingle; num / den: the threshold; near: share of equal coordinates below which a pair is
    not linked; first: the depth of the nodes that are compared; tile: rows, and tile_items: shingles, that one task compares
    with as many."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    trees: int = 12
    first: int = 3
    near: float = 0.53
    tile: int = 4096
    tile_items: int = 4 << 20


def shingles(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text, and the sorted distinct 64-bit hashes of each text's shingles of lower-cased words."""
    offsets, word = word_hashes(text, lower=True)
    n = np.diff(offsets)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(offsets[:-1] - ends[:-1], count) + np.arange(ends[-1])
    limit = np.repeat(offsets[1:], count)
    h = np.full(len(first), 1, U64)
    for i in range(size):
        at = first + i
        inside = at < limit
        h = np.where(inside, mix(h * MIX_A + word[np.minimum(at, len(word) - 1)] if len(word) else h), h)
    of = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(n)))]), h[new]


def sketches(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """16 bits of each of COORDS minwise values by set; zeros for an empty set."""
    out = np.zeros((len(offsets) - 1, COORDS), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[full]
    step = 1 << 17
    if not len(full):
        return out
    # by ranges of whole sets, so that what is worked on stays in the cache
    part = (starts // step).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(full)]
    for lo, hi in zip(cuts, cuts[1:]):
        a, b = int(starts[lo]), int(offsets[full[hi - 1] + 1])
        x, at = h[a:b], starts[lo:hi] - a
        for c in range(COORDS):
            key = mix(np.array([c + 1], U64))[0]
            low = np.minimum.reduceat((x ^ key) * (MIX_B + U64(2 * c)), at)
            out[full[lo:hi], c] = (mix(low) >> U64(48)).astype(np.uint16)
    return out


def sets(docs: DataFrame, rules: Rules) -> DataFrame:
    """A row for each document: size, digest and sketch of its shingle set."""
    size = rules.shingle

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            offsets, h = shingles(b.column(1), size)
            sk = sketches(offsets, h)
            digest = [xxhash.xxh3_128_digest(h[i:j].tobytes()) for i, j in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(digest, pa.binary()), pa.array([x.tobytes() for x in sk], pa.binary())], names=["doc_id", "n_shingles", "digest", "sketch"])

    return columns(docs, "doc_id", "text").mapInArrow(emit, SETS)


def children(row: np.ndarray, path: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children that rows at nodes enter: the node's path picks one coordinate, or two for a quarter of the nodes."""
    j = (path % U64(COORDS)).astype(np.int64)
    two = np.flatnonzero((path >> U64(16)) % U64(4) == 0)
    k = (path[two] >> U64(8)) % U64(COORDS)
    k = k.astype(np.int64)
    two, k = two[k != j[two]], k[k != j[two]]
    r, p, c = np.concatenate([row, row[two]]), np.concatenate([path, path[two]]), np.concatenate([j, k])
    return r, mix(p * MIX_A + (sk[r, c].astype(U64) << U64(8)) + c.astype(U64))


def paths(reps: DataFrame, rules: Rules) -> DataFrame:
    """(node, doc_id): the nodes of depth `first` that each representative enters, over all trees."""
    trees, first = rules.trees, rules.first

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sk = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDS)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            n = len(ids)
            row = np.tile(np.arange(n), trees)
            path = np.repeat(mix(np.arange(1, trees + 1, dtype=U64) * MIX_B), n)
            for _ in range(first):
                row, path = children(row, path, sk)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row])], names=["node", "doc_id"])

    return reps.select("doc_id", "sketch").mapInArrow(emit, "node long, doc_id long")


def connect(n: int, linked, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what links connect among n items, comparing each pair that isn't connected already.

    linked(i, others): which of the others link with i. left: if given, only pairs of one True and one False count.
    """
    comp = np.arange(n)
    edges: list[tuple[int, int]] = []
    for i in range(n):
        if i and comp[i] == comp[0]:
            continue  # its pairs with other pieces are compared from their side
        others = np.flatnonzero(comp != comp[i])
        if left is not None:
            others = others[left[others] != left[i]]
        if len(others):
            for o in others[linked(i, others)].tolist():
                if comp[o] != comp[i]:
                    edges.append((i, o))
                    comp[comp == comp[o]] = comp[i]
    return edges


def coarse(batches: Iterator[pa.RecordBatch], near: float) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that connect rows of one node, or of a pair of its tiles, whose sketches agree enough."""
    out: list[tuple[int, int]] = []
    for t in groups(batches, "node", "a", "b"):
        n = t.num_rows
        if n < 2:
            continue
        ids = t.column("doc_id").to_numpy()
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(n, COORDS)
        if n == 2:
            if (sk[0] == sk[1]).sum() >= near * COORDS:
                out.append((ids[0], ids[1]))
        else:
            a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
            left = (t.column("tile").to_numpy() == a) if a != b else None
            out += [(ids[i], ids[j]) for i, j in connect(n, lambda i, o, sk=sk: (sk[o] == sk[i]).sum(axis=1) >= near * COORDS, left)]
        if len(out) > 20_000:
            yield edges(out)
            out = []
    if out:
        yield edges(out)


def edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])


def tiled(rows: DataFrame, key: str, tiles: str, *carried: str) -> DataFrame:
    """rows in each pair (a, b) of their group's tiles, a <= b, that they belong to; column tiles has their number."""
    t = F.pmod(F.xxhash64("doc_id"), F.col(tiles)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (F.col(tiles) - 1).cast("int")), lambda o: F.struct(F.least(o, "tile").alias("a"), F.greatest(o, "tile").alias("b")))
    return rows.withColumn("tile", t).withColumn("p", F.explode(pairs)).select(key, "p.a", "p.b", "tile", "doc_id", *carried)


def coarse_edges(reps: DataFrame, rules: Rules) -> DataFrame:
    near = rules.near
    level = paths(reps, rules)
    sizes = level.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    level = saved(level.join(sizes, "node").select("doc_id", "node", "size").join(reps.select("doc_id", "sketch"), "doc_id"), "nodes")
    rows = tiled(level.withColumn("tiles", F.ceil(F.col("size") / rules.tile)), "node", "tiles", "sketch")
    return rows.repartition("node", "a", "b").sortWithinPartitions("node", "a", "b").mapInArrow(lambda x: coarse(x, near), "u long, v long")


def confirmed(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Edges that connect sets of one coarse piece, or of a pair of its tiles, by exact similarity."""
    out: list[tuple[int, int]] = []
    for t in groups(batches, "piece", "a", "b"):
        n = t.num_rows
        if n < 2:
            continue
        ids = t.column("doc_id").to_numpy()
        own = [np.frombuffer(x, U64) for x in t.column("items").to_pylist()]
        size = np.fromiter(map(len, own), np.int64, n)
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate(own)
        if n > 2:
            flat = np.unique(flat, return_inverse=True)[1]
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        left = (t.column("tile").to_numpy() == a) if a != b else None
        flag = np.zeros(int(flat.max()) + 1 if n > 2 else 0, bool)

        def linked(i: int, others: np.ndarray) -> np.ndarray:
            if n == 2:
                both = np.array([len(np.intersect1d(own[0], own[1], assume_unique=True))])
            else:
                flag[:] = False
                flag[flat[at[i] : at[i + 1]]] = True
                both = np.add.reduceat(flag[flat].astype(np.int32), at[:-1])[others] if len(others) * 3 > n else np.array([flag[flat[at[o] : at[o + 1]]].sum() for o in others])
            return den * both >= num * (size[i] + size[others] - both)

        out += [(ids[i], ids[j]) for i, j in connect(n, linked, left)]
        if len(out) > 20_000:
            yield edges(out)
            out = []
    if out:
        yield edges(out)


def find_near(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links of similar shingle sets reach."""
    num, den, size = rules.num, rules.den, rules.shingle
    own = saved(sets(docs, rules), "sets")
    full = own.filter("n_shingles > 0 and doc_id is not null")
    # as a table of its own, so that the join with a hot digest is one of plain exchanges, which Spark can split
    classes = saved(full.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    mark = classes.select(F.col("digest").alias("of"), "first", "rep")
    # from here on up to the links a doc_id is the number of a class; all rows of one digest have one set, so any of them will do
    reps = full.join(mark, (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("of"))).dropDuplicates(["rep"])
    reps = saved(reps.select(F.col("rep").alias("doc_id"), "first", "digest", "n_shingles", "sketch"), "representatives")
    piece = components(coarse_edges(reps, rules)).withColumnsRenamed({"node": "doc_id", "component": "piece"})
    piece = reps.select("doc_id", "first", "digest", "n_shingles").join(piece, "doc_id")
    sizes = piece.groupBy("piece").agg(F.sum("n_shingles").alias("items"), F.count("*").alias("rows"))
    tiles = F.greatest(F.ceil(F.col("items") / rules.tile_items), F.ceil(F.col("rows") / rules.tile))
    piece = saved(piece.join(sizes, "piece").select("doc_id", "first", "digest", "piece", tiles.alias("tiles")), "pieces")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            offsets, h = shingles(b.column("text"), size)
            items = [h[i:j].tobytes() for i, j in zip(offsets, offsets[1:])]
            # of several texts of a doc_id the one that the class stands for
            own = pa.array([xxhash.xxh3_128_digest(x) == d for x, d in zip(items, b.column("digest").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("tiles"), pa.array(items, pa.binary())], names=["doc_id", "piece", "tiles", "items"]).filter(own)

    # only texts that a bounded filter of the pieces' documents lets pass move to the join
    key = lambda c: F.unhex(F.sha2(F.col(c).cast("string"), 256))
    needed = may_repeat(docs.sparkSession, filter_of(piece.select(key("first").alias("digest"))))
    texts = columns(docs, "doc_id", "text").withColumnRenamed("doc_id", "first").filter(needed(key("first")))
    texts = texts.join(piece, "first").select("doc_id", "digest", "piece", "tiles", "text")
    rows = tiled(texts.mapInArrow(emit, "doc_id long, piece long, tiles long, items binary"), "piece", "tiles", "items")
    links = rows.repartition("piece", "a", "b").sortWithinPartitions("piece", "a", "b").mapInArrow(lambda x: confirmed(x, num, den), "u long, v long")
    member = full.select("doc_id", "digest").join(classes, "digest").select("doc_id", "first", "rep")
    # texts of one doc_id belong together
    several = member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u < v").drop("v")
    same = member.join(several, "doc_id").filter("rep <> u").select("u", F.col("rep").alias("v")).distinct()
    comp = components(links.filter("u <> v").union(same)).withColumnsRenamed({"node": "rep"})
    least = comp.join(classes, "rep").groupBy("component").agg(F.min("first").alias("least"))
    comp = comp.join(least, "component").select("rep", "least")
    mine = member.join(comp, "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("least", "first").alias("c"))
    mine = mine.groupBy("id").agg(F.min("c").alias("c"))
    return own.select("doc_id", "n_shingles").join(mine, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def drop_near(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with one document of each group of near-duplicates, the one with the smallest doc_id."""
    gone = find_near(docs, rules).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
