"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, dropped, saved

#: Edges that one task may finish in memory (about 200 bytes each).
ONE_TASK = 1_000_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges (u, v) that a task sees by a spanning forest of them."""
    seen, out = Forest(), []
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if seen.join(u, v):
                out.append((u, v))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["u", "v"])


def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges, in one task."""
    seen = Forest()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen.join(u, v)
    nodes = list(seen.up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([seen.root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (u, v: long, not null) reaches.

    Nodes without edges don't appear; loops and repeated edges are harmless; no edges give no rows. Each task first
    reduces its edges to a spanning forest. While more than `one_task` edges are left, a round contracts the graph:
    each node goes to the neighbour, itself included, with the smallest hash of that round, which leaves a constant
    share of the nodes; the rounds' maps are composed at the end. Then one task joins the rest, whose number is known.
    """
    schema = "u long, v long"
    left = saved(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").mapInArrow(forest, schema), "edges")
    maps: list[DataFrame] = []
    while left.count() > one_task:
        salt = len(maps)
        both = left.union(left.select("v", "u")).union(left.select("u", "u")).union(left.select("v", "v"))
        to = saved(both.groupBy("u").agg(F.min_by("v", F.xxhash64(F.lit(salt), "v")).alias("r")), "round")
        left2 = (left.join(to, "u").select("v", F.col("r").alias("a"))
                 .join(to.withColumnRenamed("u", "v"), "v").select(F.least("a", "r").alias("u"), F.greatest("a", "r").alias("v"))
                 .filter("u <> v").distinct().mapInArrow(forest, schema))
        left2 = saved(left2, "edges")
        dropped(left)
        left = left2
        maps.append(to)
    found = left.coalesce(1).mapInArrow(roots, "node long, component long")
    if not maps:
        return saved(found, "components")
    found = saved(found, "components")
    for to in reversed(maps):
        found = (to.join(found.withColumnRenamed("node", "r"), "r", "left")
                 .select(F.col("u").alias("node"), F.coalesce("component", "r").alias("component")))
    found = saved(found, "components")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return saved(found.join(least, "component").select("node", F.col("least").alias("component")), "components")
