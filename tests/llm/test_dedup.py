from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from idloom.llm import bytescan as bs
from idloom.llm import embedding_dedup, exact_dedup, simhash, suffix_dedup
from idloom.llm.common import connected_components


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))


def test_span_hashes_follow_content():
    data = np.frombuffer("ab cd ab  é ab".encode(), np.uint8)
    off = np.array([0, 5, len(data)])
    s, e, r = bs.runs(~bs.BLANK[data], off)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == ["ab", "cd", "ab", "é", "ab"]
    assert r.tolist() == [0, 0, 1, 1, 1]
    h = bs.span_hash(data, s, e)
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3


def test_runs_end_at_texts():
    data = np.frombuffer(b"abcd", np.uint8)
    s, e, r = bs.runs(bs.ALNUM[data], np.array([0, 2, 2, 4]))
    assert list(zip(s, e, r)) == [(0, 2, 0), (2, 4, 2)]


def test_fold_latin():
    data = np.frombuffer("ÀÉÖ×ß ABC".encode(), np.uint8)
    assert bytes(bs.fold(data)).decode() == "àéö×ß abc"


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    least = defaultdict(list)
    for x, r in want.items():
        least[r].append(x)
    assert got == {x: min(least[r]) for x, r in want.items()}


def test_exact_against_group_by(make):
    rng = random.Random(5)
    base = ["".join(rng.choices("ab", k=n)) for n in (0, 1, 7, 8, 9, 16, 17, 31, 32, 33, 64, 65, 200)]
    rows = [(i, rng.choice(base) + rng.choice(["", "a", "b"])) for i in range(300)]
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    got = {r["doc_id"]: (r["keep_id"], r["n_copies"], r["keep"]) for r in exact_dedup.exact_dedup(make(rows), 8).collect()}
    assert got == {i: (min(want[t]), len(want[t]), i == min(want[t])) for i, t in rows}


def test_exact_names_have_no_collision(make):
    rows = [(i, t) for i, t in enumerate(["ab" * 40, "ab" * 41, "ba" * 40, "ab" * 39 + "ba", "ab" * 40])]
    r = exact_dedup.identities(make(rows), 4).collect()
    names = {x["doc_id"]: (x["level"], x["name"]) for x in r}
    assert names[0] == names[4] and len(set(names.values())) == 4


def test_exact_odd_rows(spark, odd, empty):
    got = [(r["doc_id"], r["keep_id"], r["n_copies"], r["keep"]) for r in exact_dedup.exact_dedup(odd).collect()]
    assert (1, 1, 3, True) in got and (2, 1, 3, False) in got and (None, 1, 3, False) in got
    assert (3, 3, 1, True) in got and (4, 4, 2, True) in got and (5, 4, 2, False) in got and (8, 7, 2, False) in got and (9, 9, 1, True) in got
    assert got.count((2, 1, 3, False)) == 1 and got.count((10, 10, 1, True)) == 2 and (None, None, 1, True) in got
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.stage(spark, empty, "").count() == 0
    left = exact_dedup.stage(spark, odd, "")
    assert left.columns == odd.columns
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert sorted(x for x in ids if x) == [1, 3, 4, 6, 7, 9, 10, 10, 11, 12, 13] and ids.count(None) == 1


@pytest.mark.parametrize("stage", [exact_dedup.stage, simhash.stage])
def test_stages_keep_clashing_columns(spark, clashing, stage):
    got = stage(spark, clashing, "")
    assert got.columns == clashing.columns
    rows = got.collect()
    near = _brute_groups([(r["doc_id"], r["text"]) for r in clashing.collect()])
    assert sorted(r["doc_id"] for r in rows) == (list(range(7)) if stage is exact_dedup.stage else sorted(d for d, w in near.items() if w[0] == d)) and all(r["keep"] == "mine" for r in rows)


def _edited(rng, text, share):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = words(rng, 1)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = []
    for i in range(150):
        rows.append((i, words(rng, rng.randint(40, 400))))
    for i in range(150, 300):
        rows.append((i, _edited(rng, rows[rng.randrange(150)][1], rng.choice([0.01, 0.03, 0.06]))))
    return rows


def _words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())


def _near(bits):
    """Near pairs of all, as a matrix: those that share a block, and all."""
    near = (bits[:, None, :] != bits[None, :, :]).sum(2) <= simhash.MAX_DISTANCE
    blocks = simhash.block_values(bits)
    share = np.zeros_like(near)
    for c in blocks.T:
        share |= c[:, None] == c[None, :]
    return near & share, near


def _brute_groups(rows):
    """doc_id: (keep_id, group_size, n_links) by all pairs of fingerprints, for rows of distinct ids."""
    bits, _n = simhash.fingerprints(pa.array([t for _, t in rows], pa.string()))
    n = len(rows)
    some = np.array([bool(_words_of(t or "")) for _, t in rows])
    near = _near(bits)[0] & some[:, None] & some[None, :]
    np.fill_diagonal(near, False)
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(n)]
        if new == root:
            break
        root = new
    sizes = Counter(root)
    return {rows[i][0]: (rows[root[i]][0], sizes[root[i]], int(near[i].sum())) for i in range(n)}


def test_simhash_against_all_pairs(make, corpus):
    """The whole result, from all pairs at every distance up to the bound, where copies, texts without words and hubs are."""
    rows = corpus + [(300 + i, corpus[5][1]) for i in range(20)] + [(400, ""), (401, None), (402, "..."), (403, None)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["n_links"], r["keep"]) for r in simhash.simhash_near_dedup(make(rows)).collect()}
    want = _brute_groups(rows)
    assert got == {d: (*w, w[0] == d) for d, w in want.items()} and sum(w[1] > 1 for w in want.values()) > 200


def test_simhash_distances_cover_the_bound(corpus):
    """The fixture has pairs near the bound, not only easy ones."""
    bits, _n = simhash.fingerprints(pa.array([t for _, t in corpus]))
    d = np.triu((bits[:, None, :] != bits[None, :, :]).sum(2), 1)
    assert ((d > 36) & (d <= simhash.MAX_DISTANCE)).sum() >= 10 and ((d > 0) & (d <= 15)).sum() > 5
    found, near = (x.sum() for x in _near(bits))
    assert found >= 0.997 * near


def test_simhash_guarantee_of_blocks():
    """Fingerprints at distance 15 or less share a block whatever bits differ."""
    rng = np.random.default_rng(1)
    x = rng.random((200, simhash.N_BITS)) < 0.5
    y = x.copy()
    for row in y:
        row[rng.choice(simhash.N_BITS, 15, replace=False)] ^= True
    a, b = simhash.block_values(x), simhash.block_values(y)
    n = simhash.N_BLOCKS
    for o in range(simhash.N_ORDERS):
        assert (a[:, o * n : (o + 1) * n] == b[:, o * n : (o + 1) * n]).any(1).all()


@pytest.mark.parametrize(("distance", "share"), [(32, 0.9995), (40, 0.998), (44, 0.998), (46, 0.996), (48, 0.993)])
def test_simhash_recall_by_distance(distance, share):
    """Up to the bound, pairs of each distance share a block, not just the average pair."""
    rng = np.random.default_rng(distance)
    x = rng.random((4000, simhash.N_BITS)) < 0.5
    y = x.copy()
    for row in y:
        row[rng.choice(simhash.N_BITS, distance, replace=False)] ^= True
    assert distance <= simhash.MAX_DISTANCE
    assert (simhash.block_values(x) == simhash.block_values(y)).any(1).mean() >= share


def test_simhash_all_pairs_at_the_bound(spark):
    """Pairs at exactly the bound are found, also those that share no block of any order; those one bit further aren't."""
    rng = np.random.default_rng(9)
    x = rng.random((12_000, simhash.N_BITS)) < 0.5
    half = len(x) // 2
    x[half:] = x[:half]
    for i in range(half):
        x[half + i, rng.choice(simhash.N_BITS, simhash.MAX_DISTANCE + i % 2, replace=False)] ^= True
    blocks = simhash.block_values(x)
    assert (~(blocks[:half:2] == blocks[half::2]).any(1)).sum() >= 3 and simhash.tiles(len(x)) > 1
    packed = np.packbits(x, axis=1).view(np.int64)
    nodes = spark.createDataFrame([(i, *map(int, r), True) for i, r in enumerate(packed)], "node long, f0 long, f1 long, f2 long, f3 long, head boolean")
    got = [(r["a"], r["b"]) for r in simhash.near_pairs(nodes).collect()]
    assert sorted(got) == [(i, half + i) for i in range(0, half, 2)]


def test_simhash_bands_against_all_pairs(monkeypatch):
    """Bands spare most comparisons and lose no pair, also where the distance is spread so that no band is equal; each pair is told once."""
    rng = np.random.default_rng(12)
    x = rng.random((6000, simhash.N_BITS)) < 0.5
    for i in range(600):
        x[3000 + i] = x[i]
        x[3000 + i, rng.choice(simhash.N_BITS, i % 60, replace=False)] ^= True
    for i in range(40):  # 48 or 49 bits, as even over the bands as can be
        x[4000 + i] = x[1000 + i]
        at = [p for places in zip(*[p[:3] for p, _ in simhash.bands(simhash.N_BITS, simhash.MAX_DISTANCE, 12)], strict=True) for p in places]
        x[4000 + i, at[: simhash.MAX_DISTANCE + i % 2]] ^= True
    bits = np.packbits(x, axis=1, bitorder="little").view(np.uint64)
    d = np.bitwise_count(bits[:, None, :] ^ bits[None, :, :]).sum(2)
    monkeypatch.setattr(simhash, "SMALL_TILE", 0)
    monkeypatch.setattr(simhash, "_width", lambda na, nb: 12)
    monkeypatch.setattr(simhash, "_compare", lambda *a: pytest.fail("compared whole"))
    by = simhash.bands(simhash.N_BITS, simhash.MAX_DISTANCE, 12)
    assert sum(b + 1 for _, b in by) == simhash.MAX_DISTANCE + 1 and simhash._candidates(bits, bits, True, by) < 6000 * 6000 / 2 / 4
    for a, b, same in ((bits, bits, True), (bits[:3500], bits[3000:], False)):
        got = [(i, j) for share in range(4) for p, q in simhash._near(a, b, same, simhash.MAX_DISTANCE, share, 4) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
        if same:
            want = {(i, j) for i, j in np.argwhere(d <= simhash.MAX_DISTANCE).tolist() if i < j}
            got = [(min(p), max(p)) for p in got]
        else:
            want = {(i, j - 3000) for i, j in np.argwhere(d <= simhash.MAX_DISTANCE).tolist() if i < 3500 and j >= 3000}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 400


def test_simhash_broadcasts_nothing_that_grows(spark, make, corpus):
    """Neither pairs nor groups are broadcast, however small Spark takes the tables to be: key rows were, which the driver can't hold."""
    rows = make(corpus)
    nodes = simhash.written(simhash._nodes(rows), "test-nodes")
    for df in (simhash.near_pairs(nodes), simhash.simhash_near_dedup(rows)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_simhash_fingerprint_is_majority():
    """Of distinct words with three votes, and of distinct pairs of neighbours with two; written as loops."""
    text = " ".join(f"w{i % 400}" for i in range(1000)) + " and the end"

    def hashes(t):
        data = np.frombuffer(t.encode(), np.uint8)
        s, e, _ = bs.runs(bs.ALNUM[data], np.array([0, len(data)]))
        return bs.span_hash(data, s, e)

    h = hashes(text)
    features = [(x, 3) for x in set(h.tolist())] + [(x, 2) for x in set(bs.gram_hash(h, 2).tolist())]
    votes = np.zeros(256)
    for x, weight in features:
        votes += weight * np.concatenate([2.0 * np.unpackbits(bs.mix(np.array([x], np.uint64), 11 + i).view(np.uint8)) - 1 for i in range(4)])
    bits, n = simhash.fingerprints(pa.array([text, None, "...", text.upper()]))
    assert n.tolist() == [403, 0, 0, 403] and (bits[0] == (votes > 0)).all() and (bits[0] == bits[3]).all()


def test_simhash_order_of_words_counts(make):
    rng = random.Random(3)
    w = [words(rng, 1) + str(i) for i in range(200)]
    mixed = rng.sample(w, len(w))
    got = {r["doc_id"]: r["keep_id"] for r in simhash.simhash_near_dedup(make([(1, " ".join(w)), (2, " ".join(mixed)), (3, " ".join(w) + " more")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_simhash_odd_rows(spark, odd, empty):
    got = [(r["doc_id"], r["keep_id"], r["keep"]) for r in simhash.simhash_near_dedup(odd).collect()]
    assert (1, 1, True) in got and (2, 1, False) in got and (None, 1, False) in got and (9, 7, False) in got and (10, 10, True) in got
    assert all((i, i, True) in got for i in (3, 4, 5, 6)) and len(got) == 16
    assert simhash.simhash_near_dedup(empty).count() == 0
    left = [r["doc_id"] for r in simhash.stage(spark, odd, "").select("doc_id").collect()]
    assert sorted(x for x in left if x) == [1, 3, 4, 5, 6, 7, 10, 10, 11, 12, 13] and left.count(None) == 1


def test_ids_of_other_types(spark, make):
    df = make([(1, "one two three four"), (2, "one two three four"), (3, "else")]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for f in (simhash.simhash_near_dedup, exact_dedup.exact_dedup):
        assert {r["doc_id"]: r["keep_id"] for r in f(df).collect()} == {"d1": "d1", "d2": "d1", "d3": "d3"}


def _brute_passages(rows, n=suffix_dedup.MIN_WORDS):
    seen = {}
    texts = [(d, t.encode().split()) for d, t in rows if d is not None and t]
    for d, w in texts:
        for i in range(len(w) - n + 1):
            low, high = seen.get(k := tuple(w[i : i + n]), (d, d))
            seen[k] = (min(low, d), max(high, d))
    out = set()
    for d, w in texts:
        span = None
        for i in range(len(w) - n + 1):
            low, high = seen[tuple(w[i : i + n])]
            if low < high:
                if span and i <= span[1]:
                    span = (span[0], i + n, min(span[2], low))
                else:
                    if span:
                        out.add((d, *span))
                    span = (i, i + n, low)
        if span:
            out.add((d, *span))
    return out


def _passages(df):
    return {(r["doc_id"], r["start_word"], r["end_word"], r["first_doc_id"]) for r in suffix_dedup.repeated_passages(df).collect()}


def test_passages_against_brute_force(make, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(suffix_dedup, "RANGE_ANCHORS", 150)
    shared = [words(rng, n) for n in (49, 50, 51, 60, 80, 200, 400)] + ["na " * 70, "la la di " * 30]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 60))]
        for _k in range(rng.randint(0, 3)):
            p = rng.choice(shared).split()
            a = rng.randint(0, max(0, len(p) - 55)) if rng.random() < 0.5 else 0
            parts += [" ".join(p[a:]), words(rng, rng.randint(0, 40))]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "\n\t".join(rows[5][1].split()))]
    want = _brute_passages(rows)
    assert len(want) > 60 and _passages(make(rows)) == want


def test_passages_one_anchor_everywhere(make):
    """Texts of one repeated word: every word is an anchor."""
    rows = [(1, "w " * 60), (2, "w " * 49), (3, "w " * 75 + "x")]
    assert _passages(make(rows)) == _brute_passages(rows)


def test_passage_in_ten_thousand_documents(make, monkeypatch):
    """One passage nearly everywhere, another in some, in many runs and ranges."""
    monkeypatch.setattr(suffix_dedup, "RANGE_ANCHORS", 2000)
    monkeypatch.setattr(suffix_dedup, "RUN_ANCHORS", 1500)
    rng = random.Random(12)
    licence, other = words(rng, 80), words(rng, 60)
    rows = [(i, f"{words(rng, rng.randint(0, 6))} {licence} {words(rng, rng.randint(0, 6))}" + (f" {other}" if i % 50 == 0 else "")) for i in range(10_000)]
    want = _brute_passages(rows)
    assert len(want) >= 10_000 and _passages(make(rows)) == want


def test_passages_clashing_columns(clashing):
    from pyspark.sql import functions as F

    df = clashing.withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 12)).withColumns({c: F.lit("mine") for c in ("words", "run", "place", "head", "first")})
    assert _passages(df) == _brute_passages([(r["doc_id"], r["text"]) for r in df.collect()]) and _passages(df)


def test_passages_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _passages(odd) == _brute_passages(rows)
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_loser_tree_gives_order_and_prefixes():
    rng = random.Random(2)
    items = [("".join(rng.choices("ab", k=rng.randint(1, 12))).encode() + b" ", b"", i, i, i) for i in range(500)]
    for k in (1, 2, 3, 7):
        runs = [suffix_dedup.Run(suffix_dedup.encode(sorted(items[j::k]))) for j in range(k)]
        before, out = b"", []
        for lcp, run in suffix_dedup.merge(runs):
            assert lcp == suffix_dedup.shared(before, run.text, 0)
            before = run.text
            out.append(run.text)
        assert out == sorted(x[0] for x in items)


def test_shared_prefix():
    for a, b in ((b"", b"x"), (b"abc", b"abc"), (b"abcd", b"abcx"), (b"a" * 100, b"a" * 99 + b"b"), (b"a" * 70, b"a" * 200)):
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert suffix_dedup.shared(a, b, 0) == want


def _vectors(n, dim, rng):
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for i in range(n // 2, n):
        x[i] = x[rng.integers(n // 2)] + rng.standard_normal(dim).astype(np.float32) * rng.choice([0.05, 0.2, 0.35])
    return x


def _brute_cosines(x, threshold=embedding_dedup.THRESHOLD):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.triu(y @ y.T, 1)
    return s, set(zip(*(c.tolist() for c in np.nonzero(s >= threshold))))


def _nodes_of(spark, x):
    rows, v = embedding_dedup.unit_vectors(pa.array([r.tolist() for r in x], pa.list_(pa.float64())))
    assert rows.tolist() == list(range(len(x)))
    return spark.createDataFrame([(i, b) for i, b in enumerate(v.to_pylist())], "node long, v binary")


@pytest.mark.parametrize(("cell_rows", "share"), [(500, 0.95), (150, 0.93)])
def test_forest_recall_against_all_pairs(spark, cell_rows, share):
    """With upper trees of depth 3 and 5, made from the sample; no pair is found that isn't one."""
    x = _vectors(3000, 32, np.random.default_rng(4))
    s, want = _brute_cosines(x)
    got = {(r["a"], r["b"]) for r in embedding_dedup.near_pairs(_nodes_of(spark, x), leaf=64, cell_rows=cell_rows).collect()}
    edge = {(a, b) for a, b in want ^ got if abs(s[a, b] - 0.9) < 1e-5}
    assert got <= want | edge and len(want) > 500 and len(got & want) >= share * len(want)


def test_forest_is_exact_where_all_share_a_leaf(spark):
    """Groups, sizes and links of one leaf against all pairs."""
    x = _vectors(240, 16, np.random.default_rng(6))
    x[200:220] = x[3]
    _, want = _brute_cosines(x)
    root = list(range(240))
    for _ in range(240):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    links = Counter(i for p in want for i in p)
    sizes = Counter(root)
    df = spark.createDataFrame([(i, v.tolist(), "mine") for i, v in enumerate(x)], "vec_id long, embedding array<float>, node string").withColumns({c: F.lit("mine") for c in ("v", "cell", "tree", "dim", "group_id", "keep", "own")})
    got = {r["vec_id"]: (r["group_id"], r["group_size"], r["n_links"], r["keep"]) for r in embedding_dedup.near_groups(df).collect()}
    assert got == {i: (root[i], sizes[root[i]], links[i], root[i] == i) for i in range(240)} and max(sizes.values()) > 20


def test_spill_on_the_way_down_is_bounded():
    """A vector that stands at the median of every split goes to 1 + depth + ... cells, by SPILLS, not to all."""
    x = np.zeros((1, 8), np.float32)
    splits = {k: (-1.0, 0.0, 1.0) for k in range(1, 1 << 10)}
    assert len(list(embedding_dedup.route(x, 0, splits, 0))) == 1 and len(list(embedding_dedup.route(x, 0, splits, 1))) == 2
    assert len(list(embedding_dedup.route(x, 0, splits, 2))) == 4


def test_forest_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [1.0, 2.0]), (12, [1.0, 2.0]), (None, v), (9, [2.0, 4.0, 6.0]), (10, [-1.0, 0.0, 0.0]), (11, [float("inf"), 0.0, 0.0])]
    rows += [(20, [float(i % 7) for i in range(5000)]), (21, [float(i % 7) for i in range(5000)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["group_id"], r["group_size"], r["n_links"], r["keep"]) for r in embedding_dedup.near_groups(df).collect()}
    assert got[1] == (1, 3, 2, True) and got[2] == (1, 3, 2, False) and got[9] == (1, 3, 2, False) and got[10] == (10, 1, 0, True) and got[None] == (None, 1, 0, True)
    assert got[8] == (8, 2, 1, True) and got[12] == (8, 2, 1, False) and got[21] == (20, 2, 1, False)
    assert all(got[i] == (i, 1, 0, True) for i in (3, 4, 5, 6, 7, 11)) and len(got) == 15
    assert embedding_dedup.near_groups(df.limit(0)).count() == 0


def test_forest_many_equal_vectors(spark):
    rows = [(i, [1.0, 1.0 + (i % 3) * 1e-4]) for i in range(900)]
    got = embedding_dedup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), leaf=16, cell_rows=100).select("group_id", "group_size", "n_links").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 900, 899)]


def test_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (5, [1.0, 0.0]), (5, [0.0, 1.0])]
    got = {r["vec_id"]: (r["group_id"], r["n_links"]) for r in embedding_dedup.near_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 5: (1, 2)}
