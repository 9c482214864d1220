"""Near-duplicate vectors by int8 tile products with error bounds.

A vector u of length one is s * q + r, with q of whole numbers up to 127 and |r| known. The products of two tiles of q
are exact in single precision (sums stay below 2**24 up to 1,040 dimensions; longer ones use double precision), and

    |u.v - s_u s_v q_u.q_v| <= |s_u q_u| |r_v| + |r_u| |s_v q_v| + |r_u| |r_v|,

so only pairs whose bound reaches the threshold are computed again in double precision.

Vectors are compared within a label. Equal vectors become one representative with a count, so a group of copies costs
one row. A label's representatives are dealt out to tiles by a hash, and each pair of tiles is a task of bounded size
that returns counts of links and a spanning forest of them, not the pairs.

Edge cases: null vectors or labels, zero vectors, and vectors with null or non-finite components link with nothing, and
neither do vectors of different lengths; a component outside double range after squaring is scaled first; repeated
rows with one vec_id are one vector if they are equal, and link if they aren't; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, columns, groups, saved
from .components import components

TILE = 2048


def quantised(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unit rows as whole numbers q and scales s, with the lengths of s * q and of the rest, rounded up."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None])
    near = q * s[:, None]
    slack = 1 + 1e-9
    return q.astype(np.float32 if x.shape[1] <= 1040 else np.float64), s, np.sqrt((near**2).sum(axis=1)) * slack, np.sqrt(((x - near) ** 2).sum(axis=1)) * slack + 1e-12


def cosines(x: np.ndarray, norm: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j])


def tile_links(x: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one from each tile (once each if it's the same tile), with cosine >= threshold."""
    x = x / np.abs(x).max(axis=1)[:, None]
    norm = np.sqrt((x**2).sum(axis=1))
    q, s, near, rest = quantised(x / norm[:, None])
    found = []
    step = 512
    for a in range(0, len(left), step):
        i = left[a : a + step]
        dots = (q[i] @ q[right].T).astype(np.float64) * s[i][:, None] * s[right]
        bound = dots + near[i][:, None] * rest[right] + rest[i][:, None] * (near[right] + rest[right]) + 1e-9
        p, o = np.nonzero(bound >= threshold)
        p, o = i[p], right[o]
        if same:
            p, o = p[p < o], o[p < o]
        for b in range(0, len(p), 1 << 18):
            c = cosines(x, norm, p[b : b + (1 << 18)], o[b : b + (1 << 18)]) >= threshold
            found.append((p[b : b + (1 << 18)][c], o[b : b + (1 << 18)][c]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2


def compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each pair of tiles: rows (u, null, links) of counts and (u, v, null) of a spanning forest."""
    for t in groups(batches, "grp", "a", "b"):
        ids, tile, count = (t.column(c).to_numpy() for c in ("rep", "tile", "n"))
        vectors = t.column("v").to_pylist()
        length = np.array([len(v) for v in vectors])
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        links = np.zeros(len(ids), np.int64)
        seen, forest = Forest(), []
        for d in np.unique(length):
            rows = np.flatnonzero(length == d)
            x = np.array([vectors[r] for r in rows], np.float64).reshape(len(rows), d)
            own = tile[rows]
            left, right = (np.flatnonzero(own == a), np.flatnonzero(own == b))
            i, j = tile_links(x, left, right, a == b, threshold)
            i, j = rows[i], rows[j]
            np.add.at(links, i, count[j])
            np.add.at(links, j, count[i])
            forest += [(p, o) for p, o in zip(ids[i].tolist(), ids[j].tolist()) if seen.join(p, o)]
        some = np.flatnonzero(links)
        u = [*ids[some].tolist(), *(e[0] for e in forest)]
        if u:
            none = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([None] * none + [e[1] for e in forest], pa.int64()), pa.array([*links[some].tolist(), *[None] * len(forest)], pa.int64())], names=["u", "v", "links"])


def find_near(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id): links to other vectors of the label, and the smallest vec_id they reach."""
    own = columns(vectors, "vec_id", "embedding", "label").withColumn("embedding", F.col("embedding").cast("array<double>"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = own.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).dropDuplicates(["vec_id", "embedding", "label"])
    # equal vectors of one label; -0.0 counts as 0.0
    good = good.select("vec_id", "label", F.transform("embedding", lambda x: x + 0.0).alias("v"))
    copies = saved(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    # a number for each label, so that no two labels meet
    tiles = saved(copies.groupBy("label").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).withColumn("grp", F.monotonically_increasing_id()), "labels")
    dealt = copies.join(tiles, "label").withColumn("tile", F.pmod(F.xxhash64("rep", "v"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, "tile").alias("a"), F.greatest(o, "tile").alias("b")))
    dealt = dealt.withColumn("p", F.explode(pairs)).select("grp", "p.a", "p.b", "tile", "rep", "n", "v")
    found = saved(dealt.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b").mapInArrow(lambda x: compare(x, threshold), "u long, v long, links long"), "links")
    links = found.filter("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    comp = components(found.filter("v is not null").select("u", "v"))
    member = good.withColumnRenamed("vec_id", "id").join(copies.select("label", "v", "rep", "n"), ["label", "v"]).select("id", "rep", "n")
    member = member.join(links, F.col("rep") == F.col("u"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    member = member.groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("c"))
    return own.select("vec_id").join(member, F.col("vec_id") == F.col("id"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
