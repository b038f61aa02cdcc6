"""Connected components by alternating star contraction, each round written to the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import release, written


def _least_neighbour(e: DataFrame) -> DataFrame:
    """Adds m, the least v of u: a partial aggregate joined back, so that no task holds the whole neighbourhood of a hub."""
    least = e.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    # by sorting: least grows with the edges, and a broadcast of it, which files' small sizes suggest, may not fit the driver
    return e.join(least.hint("merge"), F.col("u") == F.col("_u")).drop("_u")


#: Edges that are united at once.
FOREST_EDGES = 1 << 18


def _unite(nodes: np.ndarray, root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted nodes and the smallest node of each one's component, with more edges."""
    fresh = np.setdiff1d(np.concatenate([a, b]), nodes)
    at = np.searchsorted(nodes, fresh)
    nodes, root = np.insert(nodes, at, fresh), np.insert(root, at, fresh)
    a, b = root[np.searchsorted(nodes, a)], root[np.searchsorted(nodes, b)]
    left = a != b
    if left.any():
        ids, ends = np.unique(np.concatenate([a[left], b[left]]), return_inverse=True)
        x, y = np.split(ends, 2)
        label = np.arange(len(ids))
        while len(x):
            x, y = label[x], label[y]
            left = x != y
            x, y = x[left], y[left]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label = up
        # every id is the root of its nodes
        place = np.searchsorted(ids, root)
        place[place == len(ids)] = 0
        root = np.where(ids[place] == root, ids[label[place]], root)
    return nodes, root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes = root = np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= FOREST_EDGES:
            nodes, root = _unite(nodes, root, *map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        nodes, root = _unite(nodes, root, *map(np.concatenate, zip(*held, strict=True)))
    other = nodes != root
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(root[other])], ["a", "b"])


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that make the same components as edges (a, b) of longs, which may be far more than nodes: each partition returns fewer edges than
    it has nodes, before anything is shuffled. A task holds its nodes."""
    return edges.select("a", "b").mapInArrow(_forest, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component), from edges (a, b) of longs. Nodes without an edge to another don't appear.

    Loops and repeated edges are allowed. Runs jobs while the plan is made: one for each round.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    for _ in range(rounds):
        # every larger neighbour of u is linked to the least of u and its neighbours
        both = _least_neighbour(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        up = both.withColumn("m", F.least("m", "u")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # u and its smaller neighbours are linked to the least of them
        down = _least_neighbour(up).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u <> v").distinct()
        after = written(down, "components")
        release(e)
        e = after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            return roots.unionByName(e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node")))
        before = now
    raise RuntimeError("components didn't settle")
