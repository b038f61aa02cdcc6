"""Operator 4, a quality classifier: a generalised additive model with pairwise interactions.

Features are shares and means that one pass over a text's bytes gives. Each feature is cut into bins by quantiles of the training
rows. Boosting goes round the features in cycles: for each it fits a tree of depth 2 over that feature's bins to
the logistic residuals, and adds it to the feature's table. Then the pairs that lower the loss most are boosted in
the same way, with trees that cut first one feature, then the other. What is left of training are tables; the score
of a text is the sum of its bins' entries, added up for whole batches.

Training takes at most TRAIN_ROWS labelled documents (those of smallest xxhash64 of doc_id); their texts stay on the executors, only
their features come to the driver. Scoring reads every text whole, and shuffles nothing.

Defined cases: a NULL text, or one of blanks only, has score 0 and is rejected. Repeated rows get a score each. With no
labelled document, or labels of one class only, the score is the share of good labels (1 where there is none).
Labels are taken by doc_id, the largest where there are several; NULL labels don't count. Texts of any length are read whole. doc_id must be a
whole number. Only doc_id, text and the labels are read; columns of any other name are kept by the stage and left alone. An empty table
gives an empty result. Training runs while the plan is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import fresh, table

TRAIN_ROWS = 20_000
THRESHOLD = 0.5
FEATURES = ("log_bytes", "word_bytes", "upper", "digits", "symbols", "bangs", "pipes", "marked_words", "capital_words", "repeated_words", "line_words", "distinct_words")
N_BINS, PAIR_BINS, N_PAIRS = 32, 8, 8
CYCLES, PAIR_CYCLES, RATE = 60, 30, 0.15

_code = np.arange(256)
_PLAIN_MARKS = np.isin(_code, [ord(c) for c in ".,;:'\"-()?"])
_SYMBOL = ~(bs.ALNUM | bs.BLANK | _PLAIN_MARKS)


def features(text: pa.Array) -> np.ndarray:
    """Rows x FEATURES; a row of NaN where a text has no word."""
    out = np.full((len(text), len(FEATURES)), np.nan)
    for row, data, off in bs.batches(text):
        n = len(off) - 1
        s, e, r = bs.runs(~bs.BLANK[data], off)
        words = np.bincount(r, minlength=n).astype(float)
        has = words > 0
        w = np.where(has, words, 1.0)
        size = np.maximum(np.diff(off), 1).astype(float)

        def by_row(mask: np.ndarray) -> np.ndarray:
            return bs.sums(mask, off).astype(float)

        def per_word(mask: np.ndarray, r: np.ndarray = r, n: int = n) -> np.ndarray:
            return np.bincount(r, weights=mask, minlength=n)

        letters = np.maximum(by_row((bs.UPPER | bs.LOWER | bs.HIGH)[data]), 1.0)
        h = bs.span_hash(data, s, e)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        by = np.lexsort((h, r))
        k, kr = h[by], r[by]
        distinct = np.bincount(kr[np.r_[True, (k[1:] != k[:-1]) | (kr[1:] != kr[:-1])]], minlength=n) if len(k) else np.zeros(n)
        upper = np.concatenate([[0], np.cumsum(bs.UPPER[data])])
        capital = (e - s > 1) & (upper[e] - upper[s] > 1) if len(s) else np.zeros(0, bool)
        marked = _SYMBOL[data[e - 1]] if len(s) else np.zeros(0, bool)
        cols = [
            np.log1p(size), bs.sums(~bs.BLANK[data], off) / w, by_row(bs.UPPER[data]) / letters, by_row(bs.DIGIT[data]) / size, by_row(_SYMBOL[data]) / size,
            by_row(data == 33) / w, by_row(data == 124) / w, per_word(marked) / w, per_word(capital) / w, per_word(same) / w, w / (1 + by_row(data == 10)), distinct / w,
        ]
        out[row : row + n] = np.where(has[:, None], np.stack(cols, 1), np.nan)
    return out


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered bins: a greedy tree on sums of gradients and curvatures."""
    values = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = cg**2 / (ch + 1.0) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1.0)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + 1.0) + 1e-9:
            values[:cut], values[cut:] = _tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)
    return values


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree over a grid of bins that cuts one axis, then each side along the other; and its gain."""
    best, values = -1.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            out, gain = np.zeros_like(a), 0.0
            for part in (slice(0, cut), slice(cut, len(a))):
                leaf = _tree(a[part].sum(0), b[part].sum(0), 1)
                out[part] = leaf
                gain += float((2 * leaf * a[part].sum(0) - leaf**2 * b[part].sum(0)).sum())
            if gain > best:
                best, values = gain, out.T if flip else out
    return values, best


class Gam:
    """Bin edges, a table for each feature, and tables for some pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        ok = ~np.isnan(x).any(1)
        x, y = x[ok], y[ok].astype(float)
        p = float(y.mean()) if len(y) else 1.0
        self.constant = p if not len(y) or p in (0.0, 1.0) else None
        self.edges, self.coarse, self.tables, self.pairs = [], [], [], []
        if self.constant is not None:
            return
        self.base = float(np.log(p / (1 - p)))
        q = np.linspace(0, 1, N_BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, q, method="lower")) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1], method="lower")) for c in x.T]
        fine, rough = self._bins(x, self.edges), self._bins(x, self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        score = np.full(len(y), self.base)
        for _ in range(CYCLES):
            for f, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-score))
                step = RATE * _tree(np.bincount(fine[f], y - p, len(t)), np.bincount(fine[f], p * (1 - p), len(t)))
                t += step
                score += step[fine[f]]
        p = 1 / (1 + np.exp(-score))
        gains = []
        for i in range(len(self.tables)):
            for j in range(i):
                gains.append((self._grid(rough, i, j, y - p, p * (1 - p))[1], i, j))
        for _, i, j in sorted(gains, reverse=True)[:N_PAIRS]:
            self.pairs.append((i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))))
        for _ in range(PAIR_CYCLES):
            for i, j, t in self.pairs:
                p = 1 / (1 + np.exp(-score))
                step = RATE * self._grid(rough, i, j, y - p, p * (1 - p))[0]
                t += step
                score += step[rough[i], rough[j]]

    def _grid(self, rough: list[np.ndarray], i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
        at = rough[i] * shape[1] + rough[j]
        return _pair_tree(np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape))

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities that texts are good; 0 for those without a word."""
        ok = ~np.isnan(x).any(1)
        out = np.zeros(len(x))
        if self.constant is not None:
            out[ok] = self.constant
            return out
        total = np.full(int(ok.sum()), self.base)
        for t, b in zip(self.tables, self._bins(x[ok], self.edges), strict=True):
            total += t[b]
        rough = self._bins(x[ok], self.coarse)
        for i, j, t in self.pairs:
            total += t[rough[i], rough[j]]
        out[ok] = 1 / (1 + np.exp(-total))
        return out


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """At most ``most`` labelled documents, by hash of doc_id: doc_id, text, y. The ids are few by that bound, so they are broadcast."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max(target).alias("y"))
    y = y.orderBy(F.xxhash64("l_id"), "l_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(y), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Gam:
    def scan(parts):  # noqa: ANN001, ANN202
        for b in parts:
            x = features(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), lists], ["doc_id", "y", "x"])

    kind = dict(labels.dtypes)["quality"]
    rows = labelled(docs, labels, "quality", most).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y")
    got = rows.mapInArrow(scan, f"doc_id long, y {kind}, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return Gam(x, (got["y"].to_numpy() == 1))


def score_column(model: Gam) -> object:
    @F.arrow_udf("double")
    def quality_score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text)))

    return quality_score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, keep: a row for each row of docs."""
    score: Column = score_column(train(docs, labels, most))(F.col("text"))
    return docs.select("doc_id", score.alias("score")).withColumn("keep", F.col("score") >= threshold)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    c = fresh(docs, "_quality")
    scored = docs.withColumn(c, score_column(train(docs, labels, most))(F.col("text")))
    return scored.where(F.col(c) >= threshold).drop(c)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))
