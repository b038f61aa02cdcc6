"""Operator 7, near-duplicates by SimHash, exact up to the bound.

A document's features are its distinct words (letters and digits, lower case), each with three votes, and its distinct pairs of neighbouring
words, with two, so that the order of words counts. Its fingerprint has 256 bits: each is the majority of that bit over the hashes
of the features. A pair is near when its fingerprints differ in at most MAX_DISTANCE bits.

No pair within the bound is left out. Equal blocks of bits can't guarantee that at 48 of 256 bits: those that 48 flips can't all touch are 5
bits long, and the 160 blocks of earlier versions lost 0.003 of pairs at the bound. Bands of 12 to 16 bits that are nearly equal can: the
bits are cut into bands with bounds (1 or 2 bits) that add up so that a pair beyond all of them is beyond the bound. A fingerprint is compared with all
that are within the bound of a band, a fifth to a twentieth of all pairs, and each pair is told by its first such band alone. Few
fingerprints, or such that bands would spare little, are compared whole.
Pairs are united into groups; the smallest doc_id of a group stays. Tests hold the result against all pairs.

Plan: texts are read once, in Arrow batches, and leave nothing behind but fingerprints. Equal fingerprints are one node, so that
thousands of exact copies cost one row. Nodes are split into parts of PART_NODES, at most MAX_PARTS; each two parts, and each part with itself, are a
tile, whose bands are split among tasks. What is shuffled is a row of 48 bytes for each node, part and share of a tile; comparisons still grow
with the square of the different fingerprints. Half of the bits rejects nearly all pairs: a necessary condition, not a filter that
loses any. Components are found by star contraction. Jobs run while the plan is made.

Defined cases: NULL texts and texts without a word match nothing and are kept, each document as its own group; rows equal in
doc_id and text are one document; a NULL doc_id is kept only in a group without other ids. Texts of any length are read whole; a text
that repeats another's words and pairs of words, as often as it may be, is its near copy. doc_id may be of any type that can be ordered. Only doc_id
and text are read; columns of any other name are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import clear, collapse_repeats, connected_components, drop_documents, mark, table, text_key, written

N_BITS = 256
N_ORDERS = 10
N_BLOCKS = 16
BLOCK_BITS = 16
MAX_DISTANCE = 48
WORD_VOTES, PAIR_VOTES = 3, 2
NODE_BUCKETS = 1 << 16
#: Parts of the nodes at most, and nodes of one; each node is sent once for each part and share of a tile.
MAX_PARTS, PART_NODES = 64, 1 << 20
#: Pairs of rows below which a tile is compared whole.
SMALL_TILE = 1 << 30
#: Fingerprints that one is compared with at once, and pairs that are returned at once.
COMPARE_COLUMNS, PAIR_BATCH = 1 << 14, 1 << 18

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64)[:, 0]
_WORDS = [f"f{i}" for i in range(N_BITS // 64)]


def _orders() -> np.ndarray:
    return np.stack([np.arange(N_BITS) if i == 0 else np.random.default_rng(i).permutation(N_BITS) for i in range(N_ORDERS)])


def _distinct(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows, each pair of them once, in order of rows."""
    by = np.lexsort((h, r))
    h, r = h[by], r[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def fingerprints(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits (rows x 256) and numbers of distinct words."""
    bits, words = np.zeros((len(text), N_BITS), bool), np.zeros(len(text), np.int64)
    for row, data, off in bs.batches(text, bs.BATCH_BYTES // 2):
        d = bs.fold(data)
        s, e, r = bs.runs(bs.ALNUM[d], off)
        if not len(s):
            continue
        all_words = bs.span_hash(d, s, e)
        pairs = bs.gram_hash(all_words, 2)
        inside = r[1:] == r[:-1]
        h, hr = _distinct(all_words, r)
        g, gr = _distinct(pairs[inside], r[1:][inside])
        words[row : row + len(off) - 1] = np.bincount(hr, minlength=len(off) - 1)
        # words and pairs of a row lie together; byte lanes hold sums up to 255, so each row is added up in runs of 255 / 2 features
        f, fr = np.concatenate([h, g]), np.concatenate([hr, gr])
        weight = np.repeat(np.array([WORD_VOTES, PAIR_VOTES], np.uint64), [len(h), len(g)])
        by = np.argsort(fr, kind="stable")
        f, fr, weight = f[by], fr[by], weight[by]
        n = np.bincount(fr, minlength=len(off) - 1)
        chunk = np.flatnonzero((np.arange(len(f)) - (np.cumsum(n) - n)[fr]) % (255 // WORD_VOTES) == 0)
        first = np.flatnonzero(np.r_[True, np.diff(fr[chunk]) != 0])
        rows = fr[chunk[first]]
        total = np.bincount(fr, weight.astype(float), len(n)).astype(np.int64)[rows]
        for lane in range(N_BITS // 64):
            x = bs.mix(f, 11 + lane).view(np.uint8).reshape(-1, 8)
            for j in range(8):
                votes = np.add.reduceat(_SPREAD[x[:, j]] * weight, chunk).view(np.uint8).reshape(-1, 8)
                votes = np.add.reduceat(votes, first, axis=0, dtype=np.int32)
                at = lane * 64 + j * 8
                bits[row + rows, at : at + 8] = 2 * votes > total[:, None]
    return bits, words


# No pair is found by blocks any more: older tests alone, which measure what blocks would find, call block_values.
def block_values(bits: np.ndarray) -> np.ndarray:
    weights = 1 << np.arange(BLOCK_BITS)
    out = [bits[:, order[: N_BLOCKS * BLOCK_BITS]].reshape(-1, N_BLOCKS, BLOCK_BITS) @ weights for order in _orders()]
    return np.concatenate(out, axis=1).astype(np.int32)


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        bits, words = fingerprints(b.column("text"))
        packed = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(words), *[pa.array(packed[:, i]) for i in range(packed.shape[1])]], ["doc_id", "tkey", "n_words", *_WORDS])


def _nodes(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, n_words, node (equal for equal fingerprints; NULL without words), fingerprint, head (one row of each node)."""
    kind = dict(docs.dtypes)["doc_id"]
    src = docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "text")
    fp = src.mapInArrow(_scan, f"doc_id {kind}, tkey long, n_words long, " + ", ".join(f"{w} long" for w in _WORDS))
    some = F.col("n_words") > 0
    # rows without words, which may be many, are spread over the buckets by document
    fp = fp.withColumn("bucket", F.pmod(F.when(some, F.xxhash64(*_WORDS)).otherwise(F.xxhash64("doc_id", "tkey")), F.lit(NODE_BUCKETS)))
    node = F.when(some, F.col("bucket") * F.lit(1 << 40) + F.dense_rank().over(Window.partitionBy("bucket").orderBy(*_WORDS)))
    head = F.row_number().over(Window.partitionBy("bucket", *_WORDS).orderBy("doc_id", "tkey")) == 1
    return fp.withColumn("node", node).withColumn("head", head & some).select("doc_id", "tkey", "n_words", "node", *_WORDS, "head")


def tiles(n: int) -> int:
    """Into how many parts n nodes are split; each two of them, and each with itself, are a tile."""
    return max(1, min(MAX_PARTS, math.isqrt(n) // 48 if n * n < 4 * SMALL_TILE else -(-n // PART_NODES)))


def shares(parts: int) -> int:
    """Into how many tasks a tile's blocks are split, so that few tiles keep all cores busy."""
    return max(1, min(16, -(-32 // (parts * (parts + 1) // 2))))


def bands(n_bits: int, most: int, width: int) -> list[tuple[np.ndarray, int]]:
    """Places of bits and the bound of each band: fingerprints at most ``most`` bits apart are within its bound in one band at least.

    Were they beyond it in all, by one bit at least, the bits that differ would be the sum of bounds and bands or more, which is most + 1. Bands
    that need no look (bound -1) are left out.
    """
    m = max(1, n_bits // width)
    places = np.array_split(np.random.default_rng(0).permutation(n_bits), m)
    return [(np.sort(x), (most + 1) // m + (i < (most + 1) % m) - 1) for i, x in enumerate(places) if (most + 1) // m + (i < (most + 1) % m) > 0]


def _band_keys(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    key = np.zeros(len(bits), np.uint64)
    for i, p in enumerate(places):
        key |= ((bits[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)) << np.uint64(i)
    return key.astype(np.int64)


def _masks(width: int, bound: int) -> np.ndarray:
    return np.array(sorted(sum(1 << i for i in c) for k in range(bound + 1) for c in combinations(range(width), k)), np.int64)


def _compare(a: np.ndarray, b: np.ndarray, rows: np.ndarray, same: bool, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near ones of a's ``rows`` and all of b; where a is b, each two of them once. All pairs are compared by half of
    their bits, which alone differ in more than ``most`` for nearly all pairs; the rest of the bits decide on those left."""
    half = a.shape[1] // 2
    for at in range(0, len(b), COMPARE_COLUMNS):
        part = np.ascontiguousarray(b[at : at + COMPARE_COLUMNS].T)
        x, c, one = np.empty(part.shape[1], np.uint64), np.empty(part.shape[1], np.uint8), np.empty(part.shape[1], np.uint8)
        for i in rows[rows < at + part.shape[1]] if same else rows:
            lo = max(0, i + 1 - at) if same else 0
            xs, cs, ones = x[lo:], c[lo:], one[lo:]
            np.bitwise_count(np.bitwise_xor(part[0, lo:], a[i, 0], out=xs), out=cs)
            for w in range(1, half):
                np.add(cs, np.bitwise_count(np.bitwise_xor(part[w, lo:], a[i, w], out=xs), out=ones), out=cs)
            left = np.flatnonzero(cs <= most)
            if len(left):
                rest = np.bitwise_count(part[half:, lo:].take(left, axis=1) ^ a[i, half:, None]).sum(0, dtype=np.int64) + cs[left]
                hit = left[rest <= most]
                if len(hit):
                    yield np.full(len(hit), i), at + lo + hit


def _first_band(found: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, earlier: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no earlier band has found."""
    i, j = found
    new = np.ones(len(i), bool)
    x = a[i] ^ b[j]
    for places, bound in earlier:
        mask = np.zeros(a.shape[1], np.uint64)
        for p in places:
            mask[p // 64] |= np.uint64(1) << np.uint64(p % 64)
        new &= np.bitwise_count(x & mask).sum(1, dtype=np.int64) > bound
    return i[new], j[new]


def _band_pairs(a: np.ndarray, b: np.ndarray, same: bool, most: int, places: np.ndarray, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near rows of a and b that are within the band's bound; where they are the same rows, each two of them once. Rows of one key are compared
    with all rows whose keys are that near, by half of their bits first: the words that have the fewer bits of the band."""
    width = len(places)
    masks = _masks(width, bound)
    ka = _band_keys(a, places)
    kb = ka if same else _band_keys(b, places)
    by_a = np.argsort(ka, kind="stable")
    by_b = by_a if same else np.argsort(kb, kind="stable")
    start_a = np.searchsorted(ka[by_a], np.arange((1 << width) + 1))
    start_b = start_a if same else np.searchsorted(kb[by_b], np.arange((1 << width) + 1))
    in_word = np.bincount(places // 64, minlength=a.shape[1])
    words = np.argsort(in_word, kind="stable")
    half = a.shape[1] // 2
    first, rest = words[:half], words[half:]
    sorted_words = lambda x, by, of: [np.ascontiguousarray(x[by, w]) for w in of]
    wa, ra = sorted_words(a, by_a, first), sorted_words(a, by_a, rest)
    wb, rb = (wa, ra) if same else (sorted_words(b, by_b, first), sorted_words(b, by_b, rest))
    # written to again and again: fresh arrays of this size would cost more than what is computed
    x, d, one = np.empty(COMPARE_COLUMNS, np.uint64), np.empty(COMPARE_COLUMNS, np.uint8), np.empty(COMPARE_COLUMNS, np.uint8)
    near_enough = np.zeros(COMPARE_COLUMNS, bool)
    for key in np.flatnonzero(np.diff(start_a)):
        near = masks ^ key
        if same:
            near = near[near >= key]
        begin = start_b[near]
        n = start_b[near + 1] - begin
        ends = np.cumsum(n)
        if not ends[-1]:
            continue
        cols = np.repeat(begin - (ends - n), n)
        cols += np.arange(len(cols))
        lo, hi = start_a[key], start_a[key + 1]
        for c0 in range(0, len(cols), COMPARE_COLUMNS):
            cs = cols[c0 : c0 + COMPARE_COLUMNS]
            parts = [w[cs] for w in wb]
            step = max(1, COMPARE_COLUMNS // len(cs))
            for r0 in range(lo, hi, step):
                r1 = min(hi, r0 + step)
                size = (r1 - r0) * len(cs)
                xs, ds, ones = (z[:size].reshape(r1 - r0, len(cs)) for z in (x, d, one))
                np.bitwise_count(np.bitwise_xor(wa[0][r0:r1, None], parts[0], out=xs), out=ds)
                for w in range(1, half):
                    np.add(ds, np.bitwise_count(np.bitwise_xor(wa[w][r0:r1, None], parts[w], out=xs), out=ones), out=ds)
                np.less_equal(d[:size], most, out=near_enough[:size])
                near_enough[size:] = False
                # by eights first, which is faster where few are left
                eights = np.flatnonzero(near_enough.view(np.uint64))
                if not len(eights):
                    continue
                e, at = np.nonzero(near_enough.reshape(-1, 8)[eights])
                left = eights[e] * 8 + at
                r, c = np.divmod(left, len(cs))
                r += r0
                c = cs[c]
                total = d[left].astype(np.int64)
                for u, v in zip(ra, rb, strict=True):
                    total += np.bitwise_count(u[r] ^ v[c])
                hit = np.flatnonzero(total <= most)
                if len(hit):
                    i, j = by_a[r[hit]], by_b[c[hit]]
                    if same:
                        # of one key, both orders are met, and each row itself
                        once = (ka[i] != ka[j]) | (i < j)
                        i, j = i[once], j[once]
                    if len(i):
                        yield i, j


def _width(na: int, nb: int) -> int:
    """Bits of a band: some 64 rows share a key, so that comparisons outweigh what each key costs."""
    return min(16, max(8, round(math.log2(max(1, math.isqrt(na * nb)) / 64))))


def _candidates(a: np.ndarray, b: np.ndarray, same: bool, by: list[tuple[np.ndarray, int]]) -> float:
    """How many pairs bands compare."""
    total = 0.0
    for places, bound in by:
        ha = np.bincount(_band_keys(a, places), minlength=1 << len(places)).astype(float)
        hb = ha if same else np.bincount(_band_keys(b, places), minlength=1 << len(places)).astype(float)
        at = np.arange(len(ha))
        total += sum(float(ha @ hb[at ^ m]) for m in _masks(len(places), bound))
    return total / 2 if same else total


def _near(a: np.ndarray, b: np.ndarray, same: bool, most: int, share: int, n_shares: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Share ``share`` of the near rows of a and b, all of which are shares 0 to n_shares - 1 together, each pair once."""
    by = bands(a.shape[1] * 64, most, _width(len(a), len(b)))
    if len(a) * len(b) < SMALL_TILE or _candidates(a, b, same, by) > len(a) * len(b) / (3 if same else 1.5):
        # few rows, or rows so alike that bands would spare little
        yield from _compare(a, b, np.arange(share, len(a), n_shares), same, most)
        return
    for k in range(share, len(by), n_shares):
        found: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for i, j in _band_pairs(a, b, same, most, *by[k]):
            found.append((i, j))
            n += len(i)
            if n >= PAIR_BATCH:
                yield _first_band(tuple(np.concatenate(x) for x in zip(*found, strict=True)), a, b, by[:k])
                found, n = [], 0
        if found:
            yield _first_band(tuple(np.concatenate(x) for x in zip(*found, strict=True)), a, b, by[:k])


def _tile_pairs(parts: Iterator[pa.RecordBatch], most: int, n_shares: int) -> Iterator[pa.RecordBatch]:
    """a, b of rows (tile, part, node, fingerprint); the rows of a tile's share are all in one partition."""
    batches = [b for b in parts if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    tile, part, node = (t.column(c).to_numpy() for c in ("tile", "part", "node"))
    bits = np.stack([t.column(w).to_numpy() for w in _WORDS], axis=1).view(np.uint64)
    del batches, t
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for task in np.unique(tile):
        k, share = divmod(int(task), n_shares)
        rows = np.flatnonzero(tile == task)
        j = (math.isqrt(8 * k + 1) - 1) // 2
        i = k - j * (j + 1) // 2
        first, second = rows[part[rows] == i], rows[part[rows] == j]
        for x, y in _near(bits[first], bits[second], i == j, most, share, n_shares):
            found.append((node[first[x]], node[second[y]]))
            n += len(x)
            if n >= PAIR_BATCH:
                yield _pair_batch(found)
                found, n = [], 0
    if n:
        yield _pair_batch(found)


def _pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def near_pairs(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """All pairs a < b of nodes that differ in at most max_distance bits, each once. Counts the nodes while the plan is made."""
    heads = nodes.where("head").select("node", *_WORDS)
    n = tiles(heads.count())
    m = shares(n)
    rows = heads.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int"))
    tile = lambda k: (F.greatest(k, "part") * (F.greatest(k, "part") + 1) / 2).cast("int") + F.least(k, "part")
    to = F.transform(F.sequence(F.lit(0), F.lit(n * m - 1)), lambda x: tile((x / m).cast("int")) * m + x % m)
    rows = rows.select(F.explode(to).alias("tile"), "part", "node", *_WORDS).repartitionById(n * (n + 1) // 2 * m, F.col("tile"))
    return rows.mapInArrow(lambda parts: _tile_pairs(parts, max_distance, m), "a long, b long")


def groups(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row for each (doc_id, tkey): doc_id, tkey, n_rows, keep_id, group_size, n_links, keep."""
    nodes = written(_nodes(docs), "op7-nodes")
    pairs = written(near_pairs(nodes, max_distance), "op7-pairs")
    roots = connected_components(pairs)
    rows = nodes.groupBy("doc_id", "tkey", "node").agg(F.count("*").alias("n_rows"))
    # what is joined grows with the corpus, and Spark takes it for as small as its compressed files: by sorting, since broadcasts may not fit the driver
    roots = roots.hint("merge")
    sizes = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("own"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("own").alias("others"))
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("tkey").alias("z"))
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # a group may be a third of all rows: it is aggregated before it is joined back
    best = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    per_node = sizes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(others.hint("merge"), "node", "left").join(best.hint("merge"), "root")
    per_node = per_node.select(F.col("node").alias("m"), "best", "group_size", (F.coalesce("others", F.lit(0)) + F.col("own") - 1).alias("n_links"))
    rows = rows.drop("root").join(per_node.hint("merge"), F.col("node") == F.col("m"), "left")
    lone = F.col("best").isNull()
    keep = lone | (F.col("best.y").eqNullSafe(F.col("doc_id")) & (F.col("best.z") == F.col("tkey")))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return rows.select("doc_id", "tkey", "n_rows", F.when(lone, F.col("doc_id")).otherwise(F.col("best.y")).alias("keep_id"), F.coalesce("group_size", one).alias("group_size"), F.coalesce("n_links", zero).alias("n_links"), keep.alias("keep"))


def simhash_near_dedup(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """A row for each document: doc_id, keep_id (smallest doc_id of its group), group_size, n_links (documents it is near to), keep."""
    return groups(docs, max_distance).select("doc_id", "keep_id", "group_size", "n_links", "keep")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the near-duplicates of a smaller doc_id; repeated rows become one."""
    start = mark()
    g = written(groups(docs), "op7-groups")
    clear(spark, start, g)
    repeats = bool(g.agg(F.max("n_rows") > 1).first()[0])
    return collapse_repeats(drop_documents(docs, g.where(~F.col("keep"))), repeats)
