"""Plain Python versions of the operators' methods, in loops, for tests."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np

from idloom.llm import packing, quality, token_output, toxicity


def features(text):
    """The quality features of an ASCII text; None where it has no word."""
    words = (text or "").split()
    if not words:
        return None
    n, w = len(text), len(words)
    up, letters = sum(c.isupper() for c in text), max(sum(c.isalpha() for c in text), 1)
    symbol = lambda c: not (c.isalnum() or c.isspace() or c in ".,;:'\"-()?")
    return [
        math.log1p(n), sum(map(len, words)) / w, up / letters, sum(c.isdigit() for c in text) / n, sum(map(symbol, text)) / n, text.count("!") / w, text.count("|") / w,
        sum(symbol(x[-1]) for x in words) / w, sum(len(x) > 1 and sum(c.isupper() for c in x) > 1 for x in words) / w, sum(a == b for a, b in zip(words, words[1:])) / w,
        w / (1 + text.count("\n")), len(set(words)) / w,
    ]


def _tree(g, h, depth):
    G, H = sum(g), sum(h)
    best, cut = None, None
    if depth and len(g) > 1:
        for c in range(1, len(g)):
            a, b = sum(g[:c]), sum(h[:c])
            gain = a * a / (b + 1) + (G - a) ** 2 / (H - b + 1)
            if best is None or gain > best + 1e-12:
                best, cut = gain, c
        if best > G * G / (H + 1) + 1e-9:
            return _tree(g[:cut], h[:cut], depth - 1) + _tree(g[cut:], h[cut:], depth - 1)
    return [G / (H + 1)] * len(g)


def _grid_tree(g, h):
    """Values and gain of the best tree over a grid that cuts one axis, then each side along the other."""
    best, out = -1.0, None
    for flip in (False, True):
        a, b = (list(map(list, zip(*m))) if flip else m for m in (g, h))
        for cut in range(1, len(a)):
            gain, rows = 0.0, []
            for part in (range(cut), range(cut, len(a))):
                G = [sum(a[i][j] for i in part) for j in range(len(a[0]))]
                H = [sum(b[i][j] for i in part) for j in range(len(a[0]))]
                leaf = _tree(G, H, 1)
                rows += [leaf for _ in part]
                gain += sum(2 * x * p - x * x * q for x, p, q in zip(leaf, G, H))
            if gain > best + 1e-12:
                best, out = gain, list(map(list, zip(*rows))) if flip else rows
    return (out if out is not None else [[0.0] * len(g[0]) for _ in g]), best


class Gam:
    """The additive model, refitted in loops: rows of features (None is a text without words) and labels 0 or 1."""

    def __init__(self, rows, y):
        pairs = [(r, float(v)) for r, v in zip(rows, y) if r is not None]
        rows, y = [r for r, _ in pairs], [v for _, v in pairs]
        share = sum(y) / len(y) if y else 1.0
        self.constant = share if share in (0.0, 1.0) or not y else None
        if self.constant is not None:
            return
        self.base = math.log(share / (1 - share))
        cols = list(zip(*rows))

        def edges(col, n):
            s = sorted(col)
            return sorted({s[math.floor(q * (len(s) - 1))] for q in np.linspace(0, 1, n + 1)[1:-1]})

        self.fine, self.rough = [edges(c, quality.N_BINS) for c in cols], [edges(c, quality.PAIR_BINS) for c in cols]
        self.tables, self.pairs = [[0.0] * (len(e) + 1) for e in self.fine], []
        fine = [[self._bin(e, v) for v in c] for e, c in zip(self.fine, cols)]
        rough = [[self._bin(e, v) for v in c] for e, c in zip(self.rough, cols)]
        score = [self.base] * len(y)

        def slopes():
            p = [1 / (1 + math.exp(-s)) for s in score]
            return [v - q for v, q in zip(y, p)], [q * (1 - q) for q in p]

        for _ in range(quality.CYCLES):
            for f, t in enumerate(self.tables):
                gs, hs = slopes()
                g, h = [0.0] * len(t), [0.0] * len(t)
                for b, u, v in zip(fine[f], gs, hs):
                    g[b] += u
                    h[b] += v
                step = [quality.RATE * x for x in _tree(g, h, 2)]
                for k, x in enumerate(step):
                    t[k] += x
                score[:] = [s + step[b] for s, b in zip(score, fine[f])]

        def grid(i, j):
            gs, hs = slopes()
            g = [[0.0] * (len(self.rough[j]) + 1) for _ in range(len(self.rough[i]) + 1)]
            h = [row[:] for row in g]
            for a, b, u, v in zip(rough[i], rough[j], gs, hs):
                g[a][b] += u
                h[a][b] += v
            return _grid_tree(g, h)

        gains = sorted(((grid(i, j)[1], i, j) for i in range(len(cols)) for j in range(i)), reverse=True)[: quality.N_PAIRS]
        self.pairs = [(i, j, [[0.0] * (len(self.rough[j]) + 1) for _ in range(len(self.rough[i]) + 1)]) for _, i, j in gains]
        for _ in range(quality.PAIR_CYCLES):
            for i, j, t in self.pairs:
                step = grid(i, j)[0]
                for a, row in enumerate(step):
                    for b, x in enumerate(row):
                        t[a][b] += quality.RATE * x
                score[:] = [s + quality.RATE * step[a][b] for s, a, b in zip(score, rough[i], rough[j])]

    @staticmethod
    def _bin(edges, v):
        return sum(e < v for e in edges)

    def score(self, row):
        if row is None:
            return 0.0
        if self.constant is not None:
            return self.constant
        z = self.base + sum(t[self._bin(e, v)] for t, e, v in zip(self.tables, self.fine, row))
        z += sum(t[self._bin(self.rough[i], row[i])][self._bin(self.rough[j], row[j])] for i, j, t in self.pairs)
        return 1 / (1 + math.exp(-z))


def largest(labels):
    """doc_id: its largest label that isn't NULL."""
    out = {}
    for d, v in labels:
        if d is not None and v is not None:
            out[d] = max(v, out.get(d, 0))
    return out


def quality_scores(rows, labels):
    """Scores of (doc_id, text) rows by a model fitted on those with labels."""
    y = largest(labels)
    train = sorted(((d, t) for d, t in rows if d in y), key=lambda r: r[0])
    model = Gam([features(t) for _, t in train], [y[d] == 1 for d, _ in train])
    return [model.score(features(t)) for _, t in rows]


def sentences(text):
    """Sets of words of the sentences of an ASCII text that have any."""
    return [s for s in (set(re.findall(r"[0-9a-z]+", part)) for part in re.split(r"[.!?\n]", (text or "").lower())) if s]


def toxicity_scores(rows, labels):
    """Noisy-or scores of (doc_id, text) rows, refitted in loops on those with labels."""
    y = largest(labels)
    train = [(sentences(t), y[d]) for d, t in sorted(rows, key=lambda r: r[0]) if d in y]
    n, counts = len(train), Counter(w for s, _ in train for w in set().union(*s))
    vocabulary = sorted(w for w, c in counts.items() if c >= toxicity.MIN_DOCS)
    w, m, v = ({k: 0.0 for k in [*vocabulary, None]} for _ in range(3))
    w[None] = -8.0
    sig = lambda z: 1 / (1 + math.exp(-min(40, max(-40, z))))
    chance = lambda s: sig(w[None] + sum(w[k] for k in s if k in w))
    for t in range(1, toxicity.STEPS + 1):
        g = dict.fromkeys(w, 0.0)
        for sents, label in train:
            p = [chance(s) for s in sents]
            none = math.exp(sum(math.log1p(-min(x, 1 - 1e-12)) for x in p))
            toxic = (1 - toxicity.NOISE) * none / max(1 - none + toxicity.NOISE * none, 1e-12)
            for s, x in zip(sents, p):
                slope = (toxic * x if label == 1 else -x) / n
                for k in [*(k for k in s if k in w), None]:
                    g[k] += slope
        for k in w:
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            size = math.sqrt(v[k] / (1 - 0.999**t)) + 1e-5
            w[k] += toxicity.RATE * (m[k] / (1 - 0.9**t)) / size
            if k is not None:
                cut = toxicity.RATE * toxicity.SPARSE * min(1, max(0, t / toxicity.WARM - 1)) / n / size
                w[k] = math.copysign(max(abs(w[k]) - cut, 0.0), w[k])
    w = {k: x for k, x in w.items() if k is None or abs(x) > toxicity.LEAST_WEIGHT}
    if len(w) == 1:
        w[None] = -50.0
    return [1 - math.prod(1 - chance(s) for s in sentences(t)) for _, t in rows]


def encode(text):
    return token_output.encode(token_output.encoding(), text).tolist()


def mix(rows, weights, seed):
    """(doc_id, text, source): copies, for rows of (doc_id, text, source) and their weights; equal budgets of tokens."""
    docs = {}
    for (d, t, s), weight in zip(rows, weights):
        u = (int(hashlib.md5(f"{d if d is not None else ''}|{seed}".encode()).hexdigest()[:12], 16) + 1) / 2**48
        docs[d, t, s] = (len(encode(t)), -math.log(u) / weight)
    total = Counter()
    for (_, _, s), (n, _) in docs.items():
        total[s] += n
    budget, out = sum(total.values()) // len(total), {}
    for s in total:
        epochs = budget // total[s] if total[s] else 0
        left, run = budget - epochs * total[s], 0
        for k, (n, _) in sorted(((k, v) for k, v in docs.items() if k[2] == s), key=lambda kv: kv[1][1]):
            run += n
            out[k] = epochs + (left > 0 and run <= left)
    return out


def pieces(rows, capacity):
    """How often each (doc_id, piece, IDs) must be in the windows of (doc_id, text) rows."""
    out = Counter()
    for d, t in rows:
        ids = encode(t)
        ids += [token_output.END] if ids else []
        out.update((d, k // capacity, tuple(ids[k : k + capacity])) for k in range(0, len(ids), capacity))
    return out


def filled(lengths, capacity):
    """Windows that filling one after the other gives, as sorted lengths."""
    left, out = dict(Counter(lengths)), Counter()
    while any(left.values()):
        took = packing.fill(left, capacity)
        for x, n in took.items():
            left[x] -= n
        out[tuple(sorted(Counter(took).elements()))] += 1
    return out


def unpacked(windows):
    """(pieces as ``pieces``, windows as ``filled``) of the rows that packing gives."""
    have, shape = Counter(), Counter()
    for r in windows:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        ends = [*r["starts"][1:], len(ids)]
        assert len(ids) == r["n_tokens"] and r["starts"][0] == 0
        have.update((d, p, tuple(ids[a:z])) for d, p, a, z in zip(r["doc_ids"], r["pieces"], r["starts"], ends))
        shape[tuple(sorted(z - a for a, z in zip(r["starts"], ends)))] += 1
    return have, shape


def groups_by_text(rows):
    first = {}
    for d, t in sorted(rows):
        first.setdefault(t, d)
    return first

