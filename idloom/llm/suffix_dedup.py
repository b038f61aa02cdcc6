"""Operator 5, repeated passages by a common-prefix-aware distributed merge sort of suffixes.

Finds every stretch of at least MIN_WORDS words that another document holds as well, word for word. A word is what stands
between ASCII blanks.

The order of suffixes is made to the depth that counts, MIN_WORDS words, and of those suffixes that can be in a repeat, as string sorting by
distinguishing prefixes does (prefix-doubling merge sort; Bingmann, Sanders, Schimek 2020): what is shorter in its distinguishing
prefix than PREFIX words isn't exchanged.

1. Scan. Suffixes are taken at anchors: words whose next GRAM words have the smallest hash among WINDOW places in a row. Any
   window of MIN_WORDS words has an anchor among its first WINDOW words, at the same place wherever the window occurs, so
   that anchors lose nothing. A suffix whose first PREFIX words (by hash) occur in one document alone is in no repeat. A false hit costs
   work, never a result: what repeats is decided by the merge, which compares texts.
2. Sort. Each task sorts its suffixes into a run. Suffixes of a run that are equal, and equal in what stands to their left, are one entry
   with the least and greatest document; where they are stays behind. A run goes out range by range, front-coded: length of the
   prefix shared with the entry before, and the rest. Ranges are cut at splitters of up to PREFIX words, so that a range can be as narrow
   as suffixes that share so many, from a sample that Spark sorts and thins.
3. Merge. Runs of a range are merged by a loser tree whose nodes keep the prefix length shared with the last winner:
   lengths decide where they differ, and where they don't, comparison goes on behind them, so that no shared prefix is read again.
4. Match. The merged order gives shared lengths to the right, a sort of left contexts those to the left; a window
   of MIN_WORDS words repeats where a class of equal left and right parts has two documents. Entries are joined with their places; windows
   unite into passages.

A passage in a third of all documents is one entry in each run for each anchor inside it. Near its start, where documents differ to the left, it
has an entry for each of them, of some 150 bytes, and those of one anchor stand in one range. Splitters, some 170 bytes for every
RANGE_ANCHORS suffixes that repeat, go to the driver and to each task.

Defined cases: NULL or short texts have no passage; texts of any length are read whole; rows without a doc_id are left out; rows of one doc_id are
one document, so repeats among them, and within one text, don't count; doc_id must be a whole number. Only doc_id and text are read; columns of any
other name are left alone. An empty table gives an empty result. Groups of any size are handled whole: work in a group is a sort, not
pairs. Jobs run while the plan is made.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import table, written

MIN_WORDS = 50
WINDOW, GRAM = 24, 8
PREFIX = MIN_WORDS - WINDOW + 1
RANGE_ANCHORS = 40_000
RUN_ANCHORS = 100_000
SAMPLES_A_RANGE = 48


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over x[i:i + w] for each i where that much follows."""
    parts, out, at, size = x, None, 0, 1
    while True:
        if w & size:
            n = len(x) - at - size + 1
            piece = parts[at : at + max(n, 0)]
            out = piece if out is None else op(out[: len(piece)], piece)
            at += size
        if at == w:
            return out[: max(len(x) - w + 1, 0)]
        parts = op(parts[: max(len(parts) - size, 0)], parts[size:])
        size *= 2


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number in its text, and hash of the next PREFIX words, for each anchor that so many words follow."""
    none = (np.zeros(0, np.int64),) * 3
    s, e, r = bs.runs(~bs.BLANK[data], off)
    n = len(s)
    if n < WINDOW + GRAM - 1:
        return none
    h = bs.span_hash(data, s, e)
    g = bs.gram_hash(h, GRAM)
    low = _slide(g, WINDOW, np.minimum)
    inside = r[: len(low)] == r[WINDOW + GRAM - 2 :][: len(low)]
    low = np.where(inside, low, np.uint64(0))
    pad = np.zeros(WINDOW - 1, np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), WINDOW, np.maximum)[: len(g)]
    at = np.flatnonzero((high == g) & (high > 0))
    at = at[at + PREFIX <= n]
    at = at[r[at] == r[at + PREFIX - 1]]
    first = np.searchsorted(r, np.arange(len(off) - 1))
    return r[at], at - first[r[at]], bs.gram_hash(h, PREFIX)[at].view(np.int64)


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for row, data, off in bs.batches(b.column("text")):
            r, word, h = anchors(data, off)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[row + r].astype(np.int64)), pa.array(word.astype(np.int32))], ["h", "doc_id", "word"])


def shared(a: bytes, b: bytes, k: int) -> int:
    """Length of the common prefix, k bytes of which are known."""
    most = min(len(a), len(b))
    step = 32
    while k < most:
        x, y = a[k : k + step], b[k : k + step]
        if x != y:
            n = min(len(x), len(y))
            d = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
            return k + (n if not d else n - (d.bit_length() + 7) // 8)
        k += step
        step *= 2
    return most


def encode(run: list[tuple]) -> bytes:
    """A sorted run of entries (suffix, left, number, least doc_id, greatest doc_id), front-coded and compressed."""
    lcp, tails, before = [], [], b""
    for x in run:
        k = shared(before, x[0], 0)
        lcp.append(k)
        tails.append(x[0][k:])
        before = x[0]
    lefts = [x[1] for x in run]
    n = len(run)
    ints = np.array([lcp, [len(t) for t in tails], [len(t) for t in lefts], [x[2] for x in run]], np.int32)
    head = struct.pack("<q", n) + ints.tobytes() + np.array([[x[3] for x in run], [x[4] for x in run]], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(tails) + b"".join(lefts))


class Run:
    """A run as it is read: the prefix length of each suffix with the one before is known, not compared for."""

    def __init__(self, blob: bytes, name: int = 0) -> None:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = struct.unpack_from("<q", raw)[0]
        ints = np.frombuffer(raw, np.int32, 4 * n, 8).reshape(4, n)
        at = 8 + 16 * n
        self.name, self.numbers = name, ints[3].tolist()
        low, high = np.frombuffer(raw, np.int64, 2 * n, at).reshape(2, n)
        self.low, self.high = low.tolist(), high.tolist()
        at += 16 * n
        tails = at + np.concatenate([[0], np.cumsum(ints[1], dtype=np.int64)])
        lefts = tails[-1] + np.concatenate([[0], np.cumsum(ints[2], dtype=np.int64)])
        self.raw, self.n, self.i = raw, n, -1
        self.lcp, self.tails, self.lefts = ints[0].tolist(), tails.tolist(), lefts.tolist()
        self.text = b""

    def step(self) -> int:
        """Moves on; the prefix length shared with the suffix before, or -1 at the end."""
        self.i += 1
        i = self.i
        if i >= self.n:
            self.text = None
            return -1
        k = self.lcp[i]
        self.text = self.text[:k] + self.raw[self.tails[i] : self.tails[i + 1]]
        return k

    def left(self) -> bytes:
        return self.raw[self.lefts[self.i] : self.lefts[self.i + 1]]


def merge(runs: list[Run]) -> Iterator[tuple[int, Run]]:
    """Suffixes of all runs in order: the prefix length shared with the one before, and the run that stands at it.

    A loser tree. ``known[i]`` is what run i's suffix shares with the winner it last lost to, which went the same way. At
    a node both suffixes' lengths refer to the same winner: the longer one is the smaller suffix; equal ones are compared from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    known = [0] * size
    for i in range(size):
        if i >= len(runs) or runs[i].step() < 0:
            known[i] = -1
    loser = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = runs[a].text, runs[b].text
        k = shared(x, y, ka)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, lose = play(build(2 * node), build(2 * node + 1))
        loser[node] = lose
        return win

    win = build(1)
    while known[win] >= 0:
        run = runs[win]
        yield known[win], run
        known[win] = run.step()
        node = (win + size) // 2
        while node:
            other = loser[node]
            ka, kb = known[win], known[other]
            if ka < kb:
                loser[node], win = win, other
            elif ka == kb and ka >= 0:
                win, loser[node] = play(win, other)
            node //= 2


def _suffixes(ids: list, text: pa.Array, lists: list) -> Iterator[tuple]:
    """(suffix, left context with the nearest word first, doc_id, word) of the chosen anchors."""
    for i, raw in enumerate(text.cast(pa.large_binary())):
        words = raw.as_py().split()
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends]
        forward, back = b" ".join(words) + b" ", b" ".join(words[::-1]) + b" "
        total, n = len(forward), len(words)
        for p in lists[i]:
            if p + PREFIX <= n:
                yield forward[starts[p] : starts[min(p + MIN_WORDS, n)]], back[total - starts[p] : total - starts[max(p - WINDOW + 1, 0)]], ids[i], p


def _head(suffix: bytes) -> bytes:
    """The part of a suffix by which it finds its range: suffixes that share PREFIX words are in one."""
    at = -1
    for _ in range(PREFIX):
        at = suffix.index(b" ", at + 1)
    return suffix[: at + 1]


def repeated_windows(low: np.ndarray, high: np.ndarray, right: np.ndarray, n_right: np.ndarray, lefts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words before the anchor, entries, smallest doc_id that has it) of windows that two documents have. right: words shared with the suffix before."""
    group = np.cumsum(right < PREFIX)
    size = np.bincount(group)
    first = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    several = (np.maximum.reduceat(high, first) > np.minimum.reduceat(low, first))[np.searchsorted(first, np.arange(len(low)), "right") - 1] & (size[group] > 0)
    pick = np.flatnonzero(several)
    if not len(pick):
        return
    keys = [int(group[i]).to_bytes(5) + lefts[i] for i in pick]
    order = sorted(range(len(pick)), key=keys.__getitem__)
    step = np.zeros(len(pick), np.int64)
    before = b""
    for j, i in enumerate(order):
        k = shared(before, keys[i], 0)
        step[j] = keys[i].count(b" ", 5, k) if k >= 5 else -1
        before = keys[i]
    n_left = np.array([lefts[i].count(b" ") for i in pick], np.int64)
    order = np.array(order, np.int64)
    low, high, n_right = low[pick], high[pick], n_right[pick]
    for o in range(WINDOW):
        left_class = np.empty(len(pick), np.int64)
        left_class[order] = np.cumsum(step < o) if o else group[pick][order]
        right_class = np.cumsum(right < MIN_WORDS - o)[pick]
        ok = np.flatnonzero((n_left >= o) & (n_right >= MIN_WORDS - o))
        if not len(ok):
            continue
        key = left_class[ok] * (len(right) + 1) + right_class[ok]
        by = np.argsort(key, kind="stable")
        key, idx = key[by], ok[by]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        least, most = np.minimum.reduceat(low[idx], start), np.maximum.reduceat(high[idx], start)
        which = np.searchsorted(start, np.arange(len(idx)), "right") - 1
        hit = (most > least)[which]
        yield o, pick[idx[hit]], least[which][hit]


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """run, number, near, far, first: entries whose windows with near to far words before the anchor repeat."""
    runs = [Run(b, r) for b, r in zip(pdf["blob"], pdf["run"], strict=True)]
    names, numbers, low, high, right, n_right, lefts = [], [], [], [], [], [], []
    for k, run in merge(runs):
        i = run.i
        names.append(run.name)
        numbers.append(run.numbers[i])
        low.append(run.low[i])
        high.append(run.high[i])
        text = run.text
        right.append(text.count(b" ", 0, k))
        n_right.append(text.count(b" "))
        lefts.append(run.left())
    found = list(repeated_windows(np.array(low, np.int64), np.array(high, np.int64), np.array(right), np.array(n_right), lefts)) if names else []
    if not found:
        return pd.DataFrame({c: [] for c in ("run", "number", "near", "far", "first")}).astype("int64")
    o = np.concatenate([np.full(len(e), o) for o, e, _ in found])
    e, f = (np.concatenate(c) for c in list(zip(*found, strict=True))[1:])
    by = np.lexsort((o, e))
    o, e, f = o[by], e[by], f[by]
    cut = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (o[1:] > o[:-1] + 1)])
    far = o[np.r_[cut[1:] - 1, len(o) - 1]]
    return pd.DataFrame({"run": np.array(names, np.int64)[e[cut]], "number": np.array(numbers, np.int64)[e[cut]], "near": o[cut], "far": far, "first": np.minimum.reduceat(f, cut)})


def splitters(heads: DataFrame, every: int) -> list[bytes]:
    """Each ``every``-th of the heads in order: sorted and counted by Spark, so that the driver gets no more than those."""
    n = max(1, heads.sparkSession.sparkContext.defaultParallelism)
    placed = written(heads.repartitionByRange(n, "head").sortWithinPartitions("head").withColumn("part", F.spark_partition_id()), "op5-heads")
    sizes = placed.groupBy("part").count()
    base = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each core
    sizes = sizes.select("part", F.coalesce(F.sum("count").over(base), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("head"))
    chosen = placed.withColumn("nth", nth).join(sizes, "part").where((F.col("base") + F.col("nth")) % every == 0)
    return sorted({bytes(r[0]) for r in chosen.select("head").collect()})


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (behind the last), n_words, first_doc_id (smallest doc_id that shares any window of it)."""
    src = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(src.mapInArrow(_scan, "h long, doc_id long, word int"), "op5-anchors")
    # a hash may be that of a third of all documents: it is aggregated before it is joined back
    twice = found.groupBy("h").agg((F.min("doc_id") < F.max("doc_id")).alias("twice")).where("twice").select("h")
    picked = found.join(twice, "h").groupBy("doc_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    chosen = written(src.join(picked, "doc_id"), "op5-chosen")
    total = chosen.agg(F.sum(F.size("words"))).first()[0] or 0
    n_ranges = max(1, -(-total // RANGE_ANCHORS))
    every = max(1, total // (n_ranges * SAMPLES_A_RANGE))

    def sample(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, lists = b.column("doc_id").to_pylist(), b.column("words").to_pylist()
            lists = [[p for p in x if (d * 1_000_003 + p) * 2_654_435_761 % (1 << 32) // 8 % every == 0] for d, x in zip(ids, lists, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([_head(x[0]) for x in _suffixes(ids, b.column("text"), lists)], pa.binary())], ["head"])

    cuts = splitters(chosen.mapInArrow(sample, "head binary"), SAMPLES_A_RANGE) if n_ranges > 1 else []

    def sort_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of runs by range (place, blob), and in other rows (place -1) where the entries of a run are."""
        task, n_runs = TaskContext.get().partitionId(), 0

        def flush(have: list[tuple]) -> pa.RecordBatch:
            nonlocal n_runs
            name = (task << 24) + n_runs
            n_runs += 1
            have.sort()
            entries, number = [], []
            for suffix, left, doc, _ in have:
                if entries and entries[-1][0] == suffix and entries[-1][1] == left:
                    entries[-1][4] = doc  # sorted by doc_id too
                else:
                    entries.append([suffix, left, len(entries), doc, doc])
                number.append(len(entries) - 1)
            heads = [_head(x[0]) for x in entries]
            places = np.array([bisect_right(cuts, h) for h in heads])
            cut = np.r_[np.flatnonzero(np.r_[True, places[1:] != places[:-1]]), len(entries)]
            ranges = [(int(places[i]), encode(entries[i:j])) for i, j in zip(cut, cut[1:], strict=False)]
            n = len(ranges)
            where = [pa.array([None] * n + [x], pa.list_(t)) for x, t in ((number, pa.int32()), ([x[2] for x in have], pa.int64()), ([x[3] for x in have], pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([name] * (n + 1), pa.int64()), pa.array([p for p, _ in ranges] + [-1], pa.int32()), pa.array([x for _, x in ranges] + [None], pa.binary()), *where], ["run", "place", "blob", "numbers", "docs", "words"])

        have: list[tuple] = []
        for b in parts:
            for x in _suffixes(b.column("doc_id").to_pylist(), b.column("text"), b.column("words").to_pylist()):
                have.append(x)
                if len(have) >= RUN_ANCHORS:
                    yield flush(have)
                    have = []
        if have:
            yield flush(have)

    runs = written(chosen.mapInArrow(sort_runs, "run long, place int, blob binary, numbers array<int>, docs array<long>, words array<int>"), "op5-runs")
    hits = runs.where("place >= 0").select("place", "run", "blob").groupBy("place").applyInPandas(_match, "run long, number long, near long, far long, first long")
    places = runs.where("place < 0").select("run", F.inline(F.arrays_zip("numbers", "docs", "words")))
    places = places.select(F.col("run").alias("r"), F.col("numbers").alias("n"), F.col("docs").alias("doc_id"), "words")
    spans = hits.join(places, (F.col("run") == F.col("r")) & (F.col("number") == F.col("n")))
    spans = spans.select("doc_id", (F.col("words") - F.col("far")).alias("lo"), (F.col("words") - F.col("near") + MIN_WORDS).alias("hi"), "first")
    by_doc = Window.partitionBy("doc_id").orderBy("lo", "hi")
    spans = spans.withColumn("top", F.max("hi").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("lo") <= F.col("top"), 0).otherwise(1)).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("doc_id", "island").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"), F.min("first").alias("first_doc_id"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0b]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS lo FROM w WHERE len(words) >= 50),
x AS (SELECT doc_id, lo, array_to_string(list_slice(words, lo + 1, lo + 50), ' ') AS span FROM s),
f AS (SELECT doc_id, lo, min(doc_id) OVER p AS first_doc, max(doc_id) OVER p AS last_doc FROM x WINDOW p AS (PARTITION BY span)),
g AS (SELECT DISTINCT doc_id, lo, first_doc FROM f WHERE first_doc < last_doc),
i AS (SELECT *, CASE WHEN lo - lag(lo) OVER (PARTITION BY doc_id ORDER BY lo) <= 50 THEN 0 ELSE 1 END AS new FROM g),
j AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT doc_id, CAST(min(lo) AS BIGINT) AS start_word, CAST(max(lo) + 50 AS BIGINT) AS end_word, CAST(max(lo) + 50 - min(lo) AS BIGINT) AS n_words, min(first_doc) AS first_doc_id
FROM j GROUP BY doc_id, island
"""
