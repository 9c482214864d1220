"""Operators whose state depends on their own past output: folds over a key's rows in order.

Rows are dealt out by key and sorted by key and order within a partition, so a key's rows pass one after the other; the
state goes from row to row and from Arrow batch to Arrow batch. Nothing gathers a key: memory doesn't grow with its rows,
and Spark's sort spills. A fold is sequential, so a key's rows pass through one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def folded(rows: DataFrame, key: str, order: list[str], start: tuple, step: Callable[..., tuple[tuple, tuple | None]], finish: Callable[[tuple], tuple] | None, schema: str) -> DataFrame:
    """(key, columns of schema): a fold over each key's rows, sorted by `order`.

    rows: the key, then what step(state, *values) takes; it gives the next state, and a row to put out or None.
    finish(state) gives a row for each key.
    """
    names = [key, *(x.split()[0] for x in schema.split(", "))]
    kinds = [KINDS[x.split()[1]] for x in schema.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Any = None
        state: tuple | None = None
        kind = None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *kinds])], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            for k, *values in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or k != last:
                    if state is not None and finish:
                        out.append((last, *finish(state)))
                    last, state = k, start
                state, row = step(state, *values)
                if row is not None:
                    out.append((k, *row))
            yield batch()
            out.clear()
        if state is not None and finish:
            out.append((last, *finish(state)))
            yield batch()

    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(emit, f"`{key}` {dict(rows.dtypes)[key]}, {schema}")


def circuit_breaker(hits: DataFrame, key: str, at_ms: str, order: str, refused: Column, cooldown_ms: int = 60_000) -> DataFrame:
    """(key, tries, skips, open_until): after a refused try, hits are skipped until cooldown_ms later."""

    def step(state: tuple, at: int, _, no: bool | None) -> tuple:
        until, tries, skips = state
        if at < until:
            return (until, tries, skips + 1), None
        return (at + cooldown_ms if no else until, tries + 1, skips), None

    rows = hits.select(key, F.col(at_ms).cast("long").alias("__at"), F.col(order).alias("__id"), refused.alias("__no"))
    return folded(rows, key, ["__at", "__id", "__no"], (0, 0, 0), step, lambda s: (s[1], s[2], s[0]), "tries long, skips long, open_until long")


def greedy_cuts(cuts: DataFrame, key: str, place: str, least: int = 40) -> DataFrame:
    """(key, n, cut): each key's places without those closer than `least` to the last one kept, numbered from 0."""

    def step(state: tuple, at: int) -> tuple:
        last, n = state
        return ((at, n + 1), (n, at)) if at - last >= least else (state, None)

    rows = cuts.select(key, F.col(place).cast("long").alias("__at")).filter("__at is not null")
    return folded(rows, key, ["__at"], (0, 0), step, None, "n long, cut long")


def delta_throttled(rows: DataFrame, key: str, at: str, order: str, value: str, forced: Column, least: float = 5.0) -> DataFrame:
    """(key, n_saved, last_saved): a value is saved if it is forced or differs by `least` from the last one saved."""

    def step(state: tuple, _, __, v: float | None, force: bool | None) -> tuple:
        n, saved = state
        if saved is None or force or (v is not None and abs(v - saved) >= least):
            return (n + 1, v), None
        return state, None

    own = rows.select(key, F.col(at).alias("__at"), F.col(order).alias("__id"), F.col(value).cast("double").alias("__v"), forced.alias("__f"))
    return folded(own, key, ["__at", "__id", "__v", "__f"], (0, None), step, lambda s: s, "n_saved long, last_saved double")
