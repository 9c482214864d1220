"""Compact codes of vectors: product quantisation in whole numbers, its codebooks fitted by Yinyang Lloyd rounds.

A component x is the integer floor(scale * x). Vectors are cut into `parts` equal parts, each with a codebook of its
own, which starts as that part of the vectors with the smallest ids. A round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and moves each entry to the floor of its parts' mean.

The first assignment looks at all entries. A codebook's entries are clustered into groups once, and each part keeps one
lower bound per group: no entry of the group, but for the one it is assigned to, is nearer. A later assignment lowers
each bound by how far the group's fastest entry has moved, takes the distance to its own entry anew, and scans only
groups whose bound isn't above that. Bounds are rounded down, and only a bound truly above the distance keeps a group
off, so a tie is always seen. Distances are exact: in double precision while they stay below 2**53, otherwise in whole
numbers of any size.

State (integers, codes and bounds of each vector) is a table in the shared folder for each round. What goes through the
driver are the codebooks, parts x entries integers of a part each, and their sums, which every task adds up first.

Edge cases: vectors that are null or hold null or non-finite components are dropped; so is one whose length isn't a
multiple of `parts` or not that of the smallest id's vector; with fewer vectors than entries a codebook is shorter;
rows with one vec_id are vectors of their own, in order of their components when codebooks start; null ids come last;
integers beyond 2**62 count as that; an error that doesn't fit into a long is null; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import columns, dropped, released, saved, unused

#: Codebook entries in a group, on average.
GROUP = 10
MOST = 1 << 62
#: Columns that a round makes.
NEW = ("code", "bound", "error")


def dtype(*values: np.ndarray) -> type:
    """float64 where sums of squared differences of these whole numbers are exact in it, else Python's integers."""
    most = max((int(np.abs(v).max()) for v in values if v.size), default=0)
    return np.float64 if (2 * most) ** 2 * max((v.shape[-1] for v in values), default=1) < 1 << 53 else object


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """(rows, entries): exact squared distances."""
    kind = dtype(x, book)
    x, book = x.astype(kind), book.astype(kind)
    if kind is object:
        return ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    return (x**2).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book**2).sum(axis=1)


def below(d: np.ndarray) -> np.ndarray:
    """Square roots as float32 that are never too large."""
    return np.nextafter((np.sqrt(d.astype(np.float64)) * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


def grouped(book: np.ndarray) -> np.ndarray:
    """The group of each entry: a few Lloyd rounds over the entries, from entries spread evenly."""
    n = len(book)
    k = max(1, n // GROUP)
    x = book.astype(np.float64)
    centre = x[np.arange(k) * n // k]
    group = np.zeros(n, np.int64)
    for _ in range(5):
        group = ((x[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(k):
            if (group == g).any():
                centre[g] = x[group == g].mean(axis=0)
    return group


def scan(x: np.ndarray, book: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest of some entries: its squared distance and index (the lower of equal ones), and the second least distance."""
    d = distances(x, book[members])
    at = d.argmin(axis=1)
    best = d[np.arange(len(x)), at]
    d[np.arange(len(x)), at] = np.inf
    return best, members[at], d.min(axis=1)


def assign_all(x: np.ndarray, book: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, squared distances, and bounds of each group, with every entry looked at."""
    n = len(x)
    code, best = np.full(n, -1), np.full(n, np.inf, object if dtype(x, book) is object else np.float64)
    first, second = np.full((n, k), np.inf, np.float32), np.full((n, k), np.inf, np.float32)
    for g in range(k):
        members = np.flatnonzero(group == g)
        if not len(members):
            continue
        d, at, next_ = scan(x, book, members)
        first[:, g], second[:, g] = below(d), below(next_)
        nearer = (d < best) | ((d == best) & (at < code))
        code, best = np.where(nearer, at, code), np.where(nearer, d, best)
    bound = first
    rows = np.arange(n)
    bound[rows, group[code]] = second[rows, group[code]]
    return code, best, bound


def assign_again(x: np.ndarray, book: np.ndarray, group: np.ndarray, drift: np.ndarray, code: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, distances and bounds after entries have moved, and how many distances were taken.

    drift: by group, how far its fastest entry has moved, rounded up.
    """
    n, rows = len(x), np.arange(len(x))
    kind = dtype(x, book)
    own = ((x.astype(kind) - book[code].astype(kind)) ** 2).sum(axis=1)
    bound = np.nextafter(bound - drift.astype(np.float32), np.float32(-np.inf))
    reach = np.nextafter((np.sqrt(own.astype(np.float64)) * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))
    open_ = bound <= reach[:, None]
    best, new, taken = own.copy(), code.copy(), n
    first, second = bound.copy(), bound.copy()
    for g in range(bound.shape[1]):
        some, members = np.flatnonzero(open_[:, g]), np.flatnonzero(group == g)
        if not len(some) or not len(members):
            continue
        d, at, next_ = scan(x[some], book, members)
        taken += len(some) * len(members)
        first[some, g], second[some, g] = below(d), below(next_)
        nearer = (d < best[some]) | ((d == best[some]) & (at < new[some]))
        new[some], best[some] = np.where(nearer, at, new[some]), np.where(nearer, d, best[some])
    # the own entry doesn't count in its group's bound: a scanned group has the second then
    held = group[new]
    out = first
    scanned = open_[rows, held]
    out[rows[scanned], held[scanned]] = second[rows[scanned], held[scanned]]
    # an entry that was left counts in its group's bound again, unless that group was scanned
    left = (new != code) & ~open_[rows, group[code]]
    out[rows[left], group[code][left]] = np.minimum(out[rows[left], group[code][left]], below(own[left]))
    return new, best, out, taken


def whole(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, x): sound vectors as whole numbers."""
    own = columns(vectors, "vec_id", "embedding", "label").withColumn("embedding", F.col("embedding").cast("array<double>"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)
    most = F.lit(MOST)
    number = lambda x: F.when(F.abs(x) * scale >= float(MOST), F.when(x < 0, -most).otherwise(most)).otherwise(F.floor(x * scale))
    return own.filter(F.col("embedding").isNotNull() & sound).select("vec_id", "label", F.transform("embedding", number).alias("x"))


def matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def assigned(state: DataFrame, books: np.ndarray, groups: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """state with codes and bounds for these codebooks, and each vector's error."""
    parts, k = len(books), int(groups.max()) + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_ in batches:
            for i in range(0, whole_.num_rows, 4096):
                b = whole_.slice(i, 4096)
                x, n = matrix(b.column("x")), b.num_rows
                width = x.shape[1] // parts
                code, bound, error = np.zeros((n, parts), np.uint8), np.zeros((n, parts, k), np.float32), np.zeros(n, object)
                if drift is not None:
                    old = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts)
                    held = np.frombuffer(b"".join(b.column("bound").to_pylist()), np.float32).reshape(n, parts, k)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    if drift is None:
                        code[:, p], d, bound[:, p] = assign_all(own, books[p], groups[p], k)
                    else:
                        code[:, p], d, bound[:, p], _ = assign_again(own, books[p], groups[p], drift[p], old[:, p].astype(np.int64), held[:, p])
                    error += d
                fixed = {"code": pa.array([r.tobytes() for r in code], pa.binary()), "bound": pa.array([r.tobytes() for r in bound], pa.binary()), "error": pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())}
                yield pa.RecordBatch.from_arrays([fixed.get(c, None if c in fixed else b.column(c)) for c in out.names], names=out.names)
        released()

    out = StructType([f for f in state.schema.fields if f.name not in NEW]).add("code", "binary").add("bound", "binary").add("error", "long")
    source = state if drift is not None else state.drop(*NEW)
    return source.mapInArrow(emit, out)


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floors of their parts' means; entries without parts stay."""
    parts, size, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * size, width), object), np.zeros(parts * size, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1)).reshape(-1, width)
            slot = (np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64) + np.arange(parts) * size).ravel()
            count += np.bincount(slot, minlength=parts * size)
            if x.size and int(np.abs(x).max()) * len(x) < 1 << 53:
                total += np.stack([np.bincount(slot, x[:, j], parts * size) for j in range(width)], axis=1).astype(np.int64).astype(object)
            else:
                np.add.at(total, slot, x.astype(object))
        some = np.flatnonzero(count)
        place = np.repeat(some, width)
        yield pa.RecordBatch.from_arrays([
            pa.array(place, pa.int32()), pa.array(np.tile(np.arange(width), len(some)), pa.int32()), pa.array(np.repeat(count[some], width), pa.int64()),
            pa.array([str(v) for v in total[some].ravel()], pa.string())], names=["slot", "j", "n", "total"])

    rows = state.select("code", "x").mapInArrow(add, "slot int, j int, n long, total string")
    out = books.copy()
    for r in rows.groupBy("slot", "j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # at most the numbers in the codebooks
        out[r.slot // size, r.slot % size, r.j] = int(r.total) // r.n
    return out


def encoded(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each sound vector, and the codebooks: parts x entries x components of a part."""
    sound = saved(whole(vectors, scale, parts), "vectors")
    start = [r.x for r in sound.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    if not start:
        return sound.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((parts, 0, 0), np.int64)
    length = len(start[0])
    books = np.array([x for x in start if len(x) == length], np.int64).reshape(-1, parts, length // parts).swapaxes(0, 1)
    groups = np.array([grouped(b) for b in books])
    k = int(groups.max()) + 1
    state, drift = sound.filter(F.size("x") == length), None
    for r in range(rounds + 1):
        out = saved(assigned(state, books, groups, drift), "codes")
        if r:
            dropped(state)
        state = out
        if r < rounds:
            new = moved(state, books)
            kind = dtype(new, books)
            far = np.sqrt(((new.astype(kind) - books.astype(kind)) ** 2).sum(axis=2).astype(np.float64))
            fastest = np.array([[far[p][groups[p] == g].max(initial=0) for g in range(k)] for p in range(parts)])
            books, drift = new, np.nextafter((fastest * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))
    dropped(sound)
    return state.select("vec_id", "label", "code", "error"), books


def label_errors(coded: DataFrame, salts: int = 32) -> DataFrame:
    """coded with label_error: the error summed over equal labels, nulls together.

    Sums are combined before they move; a label's sum then goes to `salts` places, so that no label's rows meet in one task.
    """
    key, none, salt, total = (unused(coded, c) for c in ("__label", "__none", "__salt", "label_error"))
    sums = coded.groupBy(F.col("label").alias(key)).agg(F.sum("error").alias(total)).withColumn(none, F.col(key).isNull())
    sums = sums.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = coded.withColumn(salt, F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return rows.join(sums, (rows[salt] == sums[salt]) & rows["label"].eqNullSafe(sums[key])).select(*[rows[c] for c in coded.columns], sums[total])
