"""Operator 9, toxicity by multiple-instance learning.

Labels are of documents, offences are in sentences. A sentence's probability is logistic in its set of words; a document is toxic
if any sentence is, so its probability is the noisy-or of its sentences'. Training maximises the likelihood of the
document labels through the noisy-or, allowing a share NOISE of toxic labels without cause; weights that stay small are
set to zero by soft thresholding. The trained model says which sentences offend, of which no label told.

Training takes at most TRAIN_ROWS labelled documents (those of smallest xxhash64 of doc_id). Executors turn them into hashes of words by
sentence and count in how many documents each word is; the driver gets the words of MIN_DOCS documents or more, as numbers, and no
text. Scoring reads whole texts in Arrow batches, looks words up in one sorted table, and shuffles nothing.

Defined cases: a word is a run of letters and digits, in lower case; a sentence ends at . ! ? or a line break. A NULL text, or one
without words, has score 0. Repeated rows get a score each. Without labels of both classes,
or where no word sets them apart, nothing is toxic. Labels are
taken by doc_id, the largest where there are several; NULL labels don't count. Texts of any length are read whole. doc_id must be a whole number. Only
doc_id, text and the labels are read; columns of any other name are left alone. An empty table gives an empty result. Training runs while
the plan is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import table, written
from .quality import labelled

TRAIN_ROWS = 8_000
#: A word of one document tells it from no other; what of the rest is learned, the penalty decides.
MIN_DOCS = 2
NOISE = 0.04
STEPS, RATE = 250, 0.15
#: L1 penalty on a weight, in documents: a word that sets fewer apart than a few isn't learned.
SPARSE = 1.0
#: Steps without the penalty, and again as many until it is whole: from weights of zero no word of a few documents would outgrow it.
WARM = 80
#: Weights under this are set to zero when training is over.
LEAST_WEIGHT = 0.05
THRESHOLD = 0.5

_END = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


def sentences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each word: hash, row, number of its sentence in the batch, and the byte span of the word."""
    d = bs.fold(data)
    s, e, r = bs.runs(bs.ALNUM[d], off)
    ends = np.concatenate([[0], np.cumsum(_END[data])])
    key = ends[s]
    new = np.ones(len(s), bool)
    new[1:] = (key[1:] != key[:-1]) | (r[1:] != r[:-1])
    return bs.span_hash(d, s, e), r, np.cumsum(new) - 1, s, e


class NoisyOr:
    """Sorted word hashes, their weights, and the weight of an empty sentence."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_sent: np.ndarray | None = None) -> None:
        """docs: for each document its words' hashes and the numbers of their sentences, from 0; n_sent: its sentences, where some have none of the words."""
        self.words, self.weights, self.bias = np.zeros(0, np.uint64), np.zeros(0), -8.0
        y = np.asarray(y, float)
        if not len(y) or y.min() == y.max():
            self.bias = -50.0
            return
        n_sent = np.array([int(s[-1]) + 1 if len(s) else 0 for _, s in docs]) if n_sent is None else np.asarray(n_sent, np.int64)
        base = np.cumsum(n_sent) - n_sent
        h = np.concatenate([h for h, _ in docs])
        sent = np.concatenate([s + b for (_, s), b in zip(docs, base, strict=True)])
        doc_of = np.repeat(np.arange(len(docs)), n_sent)
        vocabulary, word = np.unique(h, return_inverse=True)
        pairs = np.unique(word.astype(np.int64) * len(doc_of) + sent)
        word, sent = pairs // len(doc_of), pairs % len(doc_of)
        by_doc = np.unique(word * len(docs) + doc_of[sent]) // len(docs)
        frequent = np.bincount(by_doc, minlength=len(vocabulary)) >= MIN_DOCS
        number = np.cumsum(frequent) - 1
        kept = frequent[word]
        word, sent, vocabulary = number[word[kept]], sent[kept], vocabulary[frequent]

        w, m, v = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
        w[-1] = self.bias
        for t in range(1, STEPS + 1):
            z = np.bincount(sent, w[word], len(doc_of)) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            none = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(docs)))
            toxic = (1 - NOISE) * none / np.maximum(1 - none + NOISE * none, 1e-12)
            slope = np.where(y[doc_of] == 1, toxic[doc_of] * p, -p) / len(docs)
            g = np.concatenate([np.bincount(word, slope[sent], len(vocabulary)), [slope.sum()]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            w += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-5)
            w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - RATE * SPARSE * min(1, max(0, t / WARM - 1)) / len(docs) / (np.sqrt(v[:-1] / (1 - 0.999**t)) + 1e-5), 0)
        used = np.abs(w[:-1]) > LEAST_WEIGHT
        self.words, self.weights, self.bias = vocabulary[used], w[:-1][used], float(w[-1]) if used.any() else -50.0

    def sentence_scores(self, h: np.ndarray, sent: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        if len(self.words) and len(h):
            seen = np.zeros(1 << 16, bool)
            seen[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True
            maybe = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
            hit = self.words[at] == h[maybe]
            pairs = np.unique(sent[maybe[hit]].astype(np.int64) * len(self.words) + at[hit])
            np.add.at(z, pairs // len(self.words), self.weights[pairs % len(self.words)])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> NoisyOr:
    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, y = b.column("doc_id"), b.column("y")
            for row, data, off in bs.batches(b.column("text")):
                h, r, sent, _, _ = sentences(data, off)
                first = np.searchsorted(r, np.arange(len(off)))
                start = np.concatenate([sent, [0]])[first[:-1]]
                own = (sent - start[r]).astype(np.int32)
                by = np.lexsort((h, sent))
                h, own, r, sent = h[by], own[by], r[by], sent[by]
                once = np.ones(len(h), bool)  # a sentence is a set of words
                once[1:] = (h[1:] != h[:-1]) | (sent[1:] != sent[:-1])
                h, own, r = h[once], own[once], r[once]
                cut = np.searchsorted(r, np.arange(len(off))).astype(np.int32)
                n = np.array([own[z - 1] + 1 if z > a else 0 for a, z in zip(cut, cut[1:], strict=False)], np.int32)
                size = len(off) - 1
                yield pa.RecordBatch.from_arrays([ids.slice(row, size), y.slice(row, size), pa.array(n), pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(cut), pa.array(own))], ["doc_id", "y", "n", "h", "s"])

    rows = labelled(docs, labels, "toxic", most).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("y").cast("int").alias("y"))
    rows = written(rows.mapInArrow(scan, "doc_id long, y int, n int, h array<long>, s array<int>"), "op9-training")
    frequent = rows.select(F.explode(F.array_distinct("h")).alias("w")).groupBy("w").count().where(F.col("count") >= MIN_DOCS).select("w")
    words = np.sort(frequent.toArrow().column(0).to_numpy())

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            w, s = [], []
            for h, sent in zip(b.column("h"), b.column("s"), strict=True):
                h, sent = h.values.to_numpy(), sent.values.to_numpy()
                at = np.searchsorted(words, h)
                known = words[np.minimum(at, len(words) - 1)] == h if len(words) else np.zeros(len(h), bool)
                w.append(at[known].astype(np.int32).tobytes())
                s.append(sent[known].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("n"), pa.array(w, pa.binary()), pa.array(s, pa.binary())], ["doc_id", "y", "n", "w", "s"])

    got = rows.mapInArrow(number, "doc_id long, y int, n int, w binary, s binary").toArrow().sort_by([("doc_id", "ascending"), ("n", "ascending"), ("w", "ascending")])
    pairs = [(words[np.frombuffer(w.as_buffer(), np.int32)].view(np.uint64), np.frombuffer(s.as_buffer(), np.int32)) for w, s in zip(got["w"], got["s"], strict=True)]
    return NoisyOr(pairs, got["y"].to_numpy() == 1, got["n"].to_numpy())


def score_batch(model: NoisyOr, text: pa.Array, threshold: float) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of texts, and their sentences at or over the threshold: start and end in characters, and probability."""
    scores, found = np.zeros(len(text)), [[] for _ in range(len(text))]
    for row, data, off in bs.batches(text):
        h, r, sent, s, e = sentences(data, off)
        if not len(h):
            continue
        first = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
        last = np.r_[first[1:], len(sent)] - 1
        p = model.sentence_scores(h, sent, len(first))
        of = r[first]
        none = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(off) - 1)
        scores[row : row + len(off) - 1] = 1 - np.exp(none)
        inner = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
        for i in np.flatnonzero(p >= threshold):
            a, b, o = s[first[i]], e[last[i]], off[of[i]]
            found[row + of[i]].append({"start": int(a - o - (inner[a] - inner[o])), "end": int(b - o - (inner[b] - inner[o])), "p": round(float(p[i]), 6)})
    return scores, found


def detect(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, toxic, sentences (start, end, p of the offending ones): a row for each row of docs."""
    model = train(docs, labels, most)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            scores, found = score_batch(model, b.column("text"), threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array(scores >= threshold), pa.array(found, spans)], ["doc_id", "score", "toxic", "sentences"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double, toxic boolean, sentences array<struct<start:int,end:int,p:double>>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
