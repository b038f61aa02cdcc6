"""Operator 2, packing into windows of fixed capacity with minimum slack.

Each window is filled by the set of remaining lengths that comes closest to its capacity and has the longest
remaining one. A dynamic program over subset sums, with integers as bitsets, finds it; backtracking tells how many
of each length it takes. The same set is used again as long as its lengths last, which is what filling window after window
would do: removing items leaves the best set best while it can still be formed.

Lengths are those of token IDs, by the tokenizer that operator 10 writes with, and one for the END behind each document; what comes out are
windows of IDs, with the documents in them and where each starts.

Plan: texts are encoded once; after that IDs travel, two bytes each. Lengths are at most the capacity, so the histogram and the plan on the
driver are bounded by the capacity whatever the corpus. Pieces get their rank among those of equal length in two levels (hash buckets,
then sums over buckets), and a search in the plan turns (length, rank) into a window and an offset; a second shuffle brings the pieces of
a window together.

Defined cases: a document longer than a window is cut into full windows and a rest, in order; a document of 0 tokens, or a NULL text, has no
piece; each row is packed, also one that repeats another. Ties among equal lengths go by hash buckets, then doc_id. A text of any length is encoded
whole. Only doc_id, of any type, and text are read; columns of any other name are left alone. An empty table gives an empty result. A job
runs while the plan is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .token_output import END, encode, encoding, id_type, ranks_path

CAPACITY = 2048
BUCKETS = 1 << 14


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length go into the next window: with one of the longest, closest to capacity, long ones first."""
    lengths = sorted((x for x, c in counts.items() if c > 0), reverse=True)
    room = capacity - lengths[0]
    mask = (1 << (room + 1)) - 1
    bits, steps = 1, []
    for x in lengths:
        if x > room:
            continue
        most = min(counts[x] - (x == lengths[0]), room // x)
        if most <= 0:
            continue
        steps.append((x, most, bits))
        have, part = bits, 1
        while most > 0:  # 1, 2, 4, ... copies at once
            use = min(part, most)
            have |= have << (use * x) & mask
            most, part = most - use, part * 2
        bits = have
        if bits >> room & 1:
            break
    total = bits.bit_length() - 1
    took = {lengths[0]: 1}
    for x, most, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - x, n + 1
        if n:
            took[x] = took.get(x, 0) + n
    return took


def windows(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many windows, lengths in each) in the order of filling."""
    left = {x: c for x, c in counts.items() if c > 0}
    out = []
    while left:
        took = fill(left, capacity)
        times = min(left[x] // n for x, n in took.items())
        for x, n in took.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((times, took))
    return out


def _segments(plan: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """For each (length, pattern): key of its first rank, pieces in a window, first window, offset of its first piece."""
    used: dict[int, int] = {}
    rows, window = [], 0
    for times, took in plan:
        at = 0
        for x, n in sorted(took.items(), reverse=True):
            rows.append(((x << 44) + used.get(x, 0), n, window, at))
            used[x] = used.get(x, 0) + n * times
            at += x * n
        window += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def encoded(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, n_tokens, ids (little-endian bytes): each document's IDs and END, cut where a window is full."""
    ranks, dtype = ranks_path(docs.sparkSession), id_type(END)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for b in parts:
            row, piece, size, ids = [], [], [], []
            for i, text in enumerate(b.column("text")):
                t = encode(enc, text.as_py()).astype(dtype)
                if len(t):
                    t = np.append(t, np.array(END, dtype))
                    for k in range(0, len(t), capacity):
                        part = t[k : k + capacity]
                        row.append(i)
                        piece.append(k // capacity)
                        size.append(len(part))
                        ids.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "piece", "n_tokens", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, n_tokens int, ids binary")


def place(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, n_tokens, ids, window_id, window_offset: where each piece of each document goes."""
    kind = dict(docs.dtypes)["doc_id"]
    key = F.xxhash64("doc_id", "piece", "ids")
    pieces = written(encoded(docs, capacity).withColumn("bucket", F.pmod(key, F.lit(BUCKETS)).cast("int")), "op2-pieces")
    counts = pieces.groupBy("n_tokens", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0).cast("long")))
    histogram = pieces.groupBy("n_tokens").count().collect()  # at most ``capacity`` rows
    keys, per, first, start = _segments(windows({r["n_tokens"]: r["count"] for r in histogram}, capacity))

    rank = F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece", F.xxhash64("ids"))) - 1
    ranked = pieces.withColumn("rank", rank).join(counts.select("n_tokens", "bucket", "base"), ["n_tokens", "bucket"])
    ranked = ranked.select("doc_id", "piece", "n_tokens", "ids", (F.col("rank") + F.col("base")).alias("rank"))

    def put(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            length, rank = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64), b.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            nth = rank - (keys[at] - (length << 44))
            window = first[at] + nth // per[at]
            offset = start[at] + (nth % per[at]) * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "n_tokens", "ids")), pa.array(window), pa.array(offset.astype(np.int32))], ["doc_id", "piece", "n_tokens", "ids", "window_id", "window_offset"])

    return ranked.mapInArrow(put, f"doc_id {kind}, piece int, n_tokens int, ids binary, window_id long, window_offset int")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row for each window: window_id, n_tokens, ids (little-endian bytes), doc_ids, pieces and starts (where each begins), in order."""
    kind = dict(docs.dtypes)["doc_id"]
    sorted_ = place(docs, capacity).repartition("window_id").sortWithinPartitions("window_id", "window_offset")
    names = ["window_id", "n_tokens", "ids", "doc_ids", "pieces", "starts"]

    def join(b: pa.RecordBatch) -> pa.RecordBatch:
        """Whole windows of pieces in order: their bytes already lie one behind the other."""
        window, size = b.column("window_id").to_numpy(), b.column("n_tokens").to_numpy().astype(np.int64)
        cut = np.r_[np.flatnonzero(np.r_[True, window[1:] != window[:-1]]), len(window)].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(size)])
        data = b"".join(b.column("ids").to_pylist())
        width = len(data) // max(int(ends[-1]), 1)
        at = ends[cut] * width
        lists = [pa.ListArray.from_arrays(pa.array(cut), b.column(c)) for c in ("doc_id", "piece", "window_offset")]
        return pa.RecordBatch.from_arrays([pa.array(window[cut[:-1]]), pa.array((ends[cut[1:]] - ends[cut[:-1]]).astype(np.int32)), pa.array([data[i:j] for i, j in zip(at, at[1:], strict=False)], pa.binary()), *lists], names)

    def assemble(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # the pieces of the last window, which may go on in the next batch
        for b in parts:
            if not b.num_rows:
                continue
            b = pa.concat_batches([*rest, b])
            window = b.column("window_id").to_numpy()
            last = int(np.searchsorted(window, window[-1]))
            if last:
                yield join(b.slice(0, last))
            rest = [b.slice(last)]
        if rest:
            yield join(rest[0])

    return sorted_.mapInArrow(assemble, f"window_id long, n_tokens int, ids binary, doc_ids array<{kind}>, pieces array<int>, starts array<int>")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
