"""Operator 3, near-duplicate embeddings by a forest of random-projection trees.

Each tree splits vectors at the median of a random direction, again and again; vectors near a split go to both sides (spill), so
that close pairs seldom part. Vectors of one leaf are compared with each other, over TREES independent trees; pairs whose
exact cosine reaches the threshold are united into groups.

Plan: one scan turns vectors into bytes of unit length; equal ones are one node. The top of each tree sends nodes to cells of about
CELL_ROWS, by splits at medians of a sample of SAMPLE_PER_CELL vectors for each cell, SAMPLE at most: beyond some 10**8 vectors cells grow
instead. A split is a seed and three numbers, so that the trees that go to each task are small. On the way down a vector is
spilled SPILLS times at most, so that copies grow with the square of the depth at most, not with a power of the table; a cell is
split further where it lies, in one task, with exact medians and spill at each level. Leaves compare by one matrix product. Pairs
are written as ids.

Defined cases: a NULL vector, one with a NULL, NaN or infinite entry, and one of zeros match nothing and are their own group; vectors of
different lengths match nothing of each other; rows of one vec_id and one vector are one; a NULL vec_id is never in a group. Rows of one
vec_id with different vectors are in one group. Many equal vectors are one node, so that no leaf is full of them. Vectors of any number of
entries are used whole. vec_id must be a whole number. Only vec_id and embedding are read; columns of any other name are left alone. An empty table
gives an empty result. Jobs run while the plan is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table, written

THRESHOLD = 0.9
TREES = 8
SPILL = 0.1
SPILLS = 2
LEAF = 256
CELL_ROWS = 20_000
SAMPLE_PER_CELL = 64
SAMPLE = 1 << 18

Split = tuple[float, float, float]
"""Bounds of the band that goes to both sides, and the median between them."""


@lru_cache(maxsize=1 << 14)
def _direction(dim: int, *seed: int) -> np.ndarray:
    d = np.random.default_rng([20_25, *seed]).standard_normal(dim).astype(np.float32)
    return d / np.linalg.norm(d)


def split(p: np.ndarray, spill: float = SPILL) -> Split | None:
    """Band and median of projections: a share of ``spill`` on each side of the median. None where all are equal."""
    if not p.min() < p.max():
        return None
    low, mid, high = np.quantile(p, [0.5 - spill, 0.5, 0.5 + spill])
    return float(low), float(mid), float(high)


def top(sample: np.ndarray, tree: int, depth: int, spill: float = SPILL) -> dict[int, Split]:
    """The upper splits of a tree by node; the children of node k are 2k and 2k + 1, and a node without a split is a cell."""
    out: dict[int, Split] = {}

    def grow(x: np.ndarray, level: int, node: int) -> None:
        if level >= depth or len(x) < 2:
            return
        p = x @ _direction(x.shape[1], tree, node)
        s = split(p, spill)
        if s is not None:
            out[node] = s
            grow(x[p <= s[1]], level + 1, 2 * node)
            grow(x[p > s[1]], level + 1, 2 * node + 1)

    grow(sample, 0, 1)
    return out


def route(x: np.ndarray, tree: int, splits: dict[int, Split], spills: int = SPILLS) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, rows that go there), spilled rows in several."""
    todo = [(1, np.arange(len(x)), np.full(len(x), spills))]
    while todo:
        node, rows, left = todo.pop()
        if not len(rows):
            continue
        if node not in splits:
            yield node, rows
            continue
        low, mid, high = splits[node]
        p = x[rows] @ _direction(x.shape[1], tree, node)
        both = (p > low) & (p <= high) & (left > 0)
        left = left - both
        for child, own in ((2 * node, p <= mid), (2 * node + 1, p > mid)):
            todo.append((child, rows[own | both], left[own | both]))


def leaves(x: np.ndarray, seed: tuple[int, ...], leaf: int = LEAF, spill: float = SPILL) -> Iterator[np.ndarray]:
    """Rows of each leaf under a cell."""
    todo = [(np.arange(len(x)), 1)]
    while todo:
        rows, node = todo.pop()
        p = x[rows] @ _direction(x.shape[1], *seed, node) if len(rows) > leaf else None
        s = split(p, spill) if p is not None else None
        if s is None:
            yield rows
            continue
        low, mid, high = s
        left, right = rows[p <= high], rows[p > low]
        if len(left) == len(rows) or len(right) == len(rows):  # a band of ties: halve without spill
            left, right = rows[p <= mid], rows[p > mid]
            if not len(left) or not len(right):
                left, right = rows[p < mid], rows[p >= mid]
        todo += [(left, 2 * node), (right, 2 * node + 1)]


def leaf_pairs(x: np.ndarray, rows: np.ndarray, threshold: float, block: int = 1024) -> Iterator[np.ndarray]:
    """Pairs of rows, as less * len(x) + greater."""
    for i in range(0, len(rows), block):
        for j in range(i, len(rows), block):
            a, b = divmod(np.flatnonzero(x[rows[i : i + block]] @ x[rows[j : j + block]].T >= threshold), len(rows[j : j + block]))
            a, b = rows[a + i], rows[b + j]
            ok = a < b if i == j else a != b
            yield np.minimum(a[ok], b[ok]) * len(x) + np.maximum(a[ok], b[ok])


def unit_vectors(col: pa.ListArray) -> tuple[np.ndarray, pa.BinaryArray]:
    """Numbers of the rows whose vectors are sound, and those, of unit length, as bytes of 32-bit floats."""
    col = col.cast(pa.list_(pa.float32()), safe=False)
    off = col.offsets.to_numpy().astype(np.int64)
    values = col.values.slice(off[0], off[-1] - off[0])
    off = off - off[0]
    bad = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else np.zeros(len(values), bool)
    v = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    bad |= ~np.isfinite(v)
    row = np.repeat(np.arange(len(col)), np.diff(off))
    square = np.bincount(row, np.where(bad, 0.0, v).astype(float) ** 2, len(col))
    ok = (np.bincount(row, bad, len(col)) == 0) & (square > 0) & ~col.is_null().to_numpy(zero_copy_only=False)
    unit = (v / np.sqrt(np.where(ok, square, 1.0))[row])[ok[row]].astype("<f4")
    sizes = np.diff(off)[ok] * 4
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return np.flatnonzero(ok), pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(unit.tobytes())])


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, without copying."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view("<f4").reshape(-1, dim) if len(col) else np.zeros((0, dim), np.float32)


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        rows, v = unit_vectors(b.column("embedding"))
        yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), v], ["vec_id", "v"])


def near_pairs(nodes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, cell_rows: int = CELL_ROWS) -> DataFrame:
    """a < b: nodes whose vectors (node, v: bytes of unit length) have a cosine of at least threshold and share a leaf of any tree."""
    tops: dict[int, list[dict[int, Split]]] = {}
    for dim, n in nodes.groupBy(F.expr("length(v) div 4")).count().collect():  # a row for each length of vectors
        depth = max(0, int(np.ceil(np.log2(n / cell_rows))))
        want = min(SAMPLE_PER_CELL << depth, SAMPLE)
        if depth:
            ofdim = nodes.where(F.length("v") == 4 * dim)
            rows = ofdim.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(np.ceil(min(1.0, 2 * want / n) * (1 << 20)))).orderBy(F.xxhash64("node")).limit(want).select("v")
            sample = _matrix(rows.toArrow().column(0), dim)
            depth = min(depth, int(np.log2(max(2, len(sample) / (SAMPLE_PER_CELL // 2)))))
            tops[dim] = [top(sample, t, depth) for t in range(trees)]

    def scatter(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            dims = np.diff(np.frombuffer(whole.column("v").cast(pa.large_binary()).buffers()[1], np.int64)[: whole.num_rows + 1]) // 4
            for dim in np.unique(dims).tolist():
                b = whole.take(pa.array(np.flatnonzero(dims == dim)))
                x = _matrix(b.column("v"), dim)
                for t in range(trees):
                    for cell, rows in route(x, t, tops[dim][t] if dim in tops else {}):
                        pick, same = pa.array(rows), np.ones(len(rows), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array((same * dim).astype(np.int32)), pa.array((same * t).astype(np.int32)), pa.array(same * cell), b.column("node").take(pick), b.column("v").take(pick)], ["dim", "tree", "cell", "node", "v"])

    def compare(t: pa.Table) -> pa.Table:
        dim, tree, cell = (t[c][0].as_py() for c in ("dim", "tree", "cell"))
        x, ids = _matrix(t["v"], dim), t["node"].to_numpy()
        found = [p for rows in leaves(x, (tree, cell), leaf) for p in leaf_pairs(x, rows, threshold)]
        a, b = divmod(np.unique(np.concatenate(found)), len(x))
        a, b = ids[a], ids[b]
        other = a != b
        return pa.table({"a": pa.array(np.minimum(a, b)[other], pa.int64()), "b": pa.array(np.maximum(a, b)[other], pa.int64())})

    placed = nodes.select("node", "v").mapInArrow(scatter, "dim int, tree int, cell long, node long, v binary")
    return placed.groupBy("dim", "tree", "cell").applyInArrow(compare, "a long, b long").distinct()


def near_groups(embeddings: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, cell_rows: int = CELL_ROWS) -> DataFrame:
    """A row for each vec_id: vec_id, group_id (smallest vec_id of its group), group_size (distinct ids), n_links (ids it is near to), keep."""
    src = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    all_ids = src.select("vec_id").distinct()
    rows = written(src.where(F.col("vec_id").isNotNull()).mapInArrow(_scan, "vec_id long, v binary").distinct(), "op3-rows")
    # equal vectors are one node, named by the smallest id; those of a third of all rows are aggregated before they are joined back
    nodes = written(rows.groupBy("v").agg(F.min("vec_id").alias("node")), "op3-nodes")
    members = written(rows.join(nodes, "v").select("vec_id", "node").distinct(), "op3-members")
    pairs = written(near_pairs(nodes, threshold, trees, leaf, cell_rows), "op3-pairs")
    roots = connected_components(pairs.unionByName(members.where("vec_id != node").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))))
    own = members.groupBy("node").agg(F.count("*").alias("own"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(own.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("own").alias("others"))
    links = own.join(others, "node", "left").select("node", (F.col("own") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    links = members.join(links, "node").groupBy(F.col("vec_id").alias("linked")).agg(F.sum("links").alias("links"))
    out = all_ids.join(roots, F.col("vec_id") == F.col("node"), "left").join(links, F.col("vec_id") == F.col("linked"), "left")
    out = out.withColumn("group_id", F.coalesce("root", "vec_id"))
    sizes = out.where("vec_id IS NOT NULL").groupBy(F.col("group_id").alias("g")).agg(F.count("*").alias("size"))
    out = out.join(sizes, F.col("group_id") == F.col("g"), "left")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return out.select("vec_id", "group_id", F.coalesce("size", one).alias("group_size"), F.coalesce("links", zero).alias("n_links"), F.col("vec_id").eqNullSafe(F.col("group_id")).alias("keep"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


#: Compares all pairs, which the small tables allow. Where the forest misses no pair both are equal.
SQL = """
WITH RECURSIVE n AS (SELECT vec_id, embedding AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings WHERE vec_id IS NOT NULL),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
      WHERE list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[]) >= 0.9 * a.norm * b.norm),
c AS (SELECT vec_id, vec_id AS root FROM n UNION SELECT c.vec_id, e.b FROM c JOIN e ON e.a = c.root),
g AS (SELECT vec_id, min(root) AS group_id FROM c GROUP BY vec_id),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, coalesce(n_links, 0) AS n_links, vec_id = group_id AS keep FROM g LEFT JOIN l ON l.a = vec_id
"""
