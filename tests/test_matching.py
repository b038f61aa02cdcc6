from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from idloom.operators import fusion, matching, nearest, reconcile

FP = "struct<number:string,auth:string,time:string,card:string,datetime:string>"
META = "struct<type:string,date:string,contractor:string,amount:string,currency:string>"
SCHEMA = f"seq long, document_key string, source_sha256 string, text_sha256 string, fingerprint {FP}, dhash string, phash string, text string, metadata {META}"


def record(seq, key=None, fp=None, dhash=None, phash=None, text=None, meta=None, sha=None, tsha=None):
    return (seq, key, sha, tsha, fp and tuple(fp.get(k) for k in ("number", "auth", "time", "card", "datetime")), dhash, phash, text, meta and tuple(meta.get(k) for k in ("type", "date", "contractor", "amount", "currency")))


def _pairs(df, **kw):
    return {(r["seq_new"], r["seq_old"]): r["reason"] for r in matching.blocked_pairs(df, **kw).collect()}


def test_rules(spark):
    m = {"type": "paragon", "date": "2025-01-01", "contractor": "DUO", "amount": "30.26", "currency": "PLN"}
    rows = [
        record(0, "A", sha="s", dhash="949cacece898bcdc", phash="00000000000000ff"), record(1, "A"), record(2, "B", sha="s"), record(3, "C", {"datetime": "20260619095251"}), record(4, "D", {"datetime": "20260619095251"}),
        record(5, "E", {"datetime": "202606190952"}), record(6, "F", {"datetime": "202606190952"}), record(7, "G", {"number": "1", "auth": "2"}), record(8, "H", {"number": "1", "auth": "2", "card": "9"}),
        record(9, "I", {"card": "9"}, "949cacece898bcdc"), record(10, "J", {"card": "9"}, "949cdcecec98bcdc"), record(11, "K", dhash="949cacece898bcdc", phash="00000000000000fe"),
        record(12, "L", text="1,11 2,22 3,33 4.44", meta=m), record(13, "M", text="1.11 2.22 3.33", meta={**m, "contractor": " duo "}), record(14, "N", text="9,99", meta=m), record(15, None, {"number": "", "auth": ""}),
        record(16, "O", phash="xyz"), record(17, "P", phash="xyz"), record(18, "Q", phash="ffff"), record(19, "R", phash="fffe"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = _pairs(df)
    assert got == {(0, 1): "document", (0, 2): "source_sha256", (3, 4): "datetime", (7, 8): "fingerprint:2", (9, 10): "fingerprint+visual", (0, 11): "visual-strong", (12, 13): "business-key", (18, 19): "visual-strong"}
    assert (0, 1) not in _pairs(df, by_document=False) and (0, 2) not in _pairs(df, by_document=False)


def _random_records(n, seed):
    rng = random.Random(seed)
    hashes = [rng.getrandbits(64) for _ in range(12)]

    def near():
        h = rng.choice(hashes)
        for b in rng.sample(range(64), rng.choice([0, 2, 5, 6, 7, 10, 14])):
            h ^= 1 << b
        return rng.choice([f"{h:016x}"] * 5 + ["", None])

    pick = lambda *x: rng.choice(x)
    out = []
    for i in range(n):
        fp = {"number": pick("", "1", "2", "3"), "auth": pick("", "", "7", "8"), "time": pick("", "", "101010"), "card": pick("", "", "1671"), "datetime": pick(None, None, "20260619095251", "202606190952")}
        meta = {"type": pick("paragon", "dokument"), "date": pick("2025-01-01", ""), "contractor": pick("A", "b", "unknown"), "amount": pick("1.00", "2.00", None), "currency": "PLN"}
        out.append(record(i, pick(f"D{i}", "D", None), fp if i % 5 else None, near(), near(), " ".join(rng.sample(["1,11", "2,22", "3,33", "4,44", "5,55"], rng.randrange(5))), meta if i % 7 else None, pick(None, None, "s1", "s2"), pick("", "", "", f"t{i % 9}")))
    return out


@pytest.mark.parametrize("by_document", [True, False])
def test_blocked_pairs_are_all_pairs(spark, by_document):
    df = spark.createDataFrame(_random_records(140, 5), SCHEMA)
    s = matching.signatures(df)
    every = s.select(F.col("seq").alias("a"), F.col("sig").alias("x")).crossJoin(s.select(F.col("seq").alias("b"), F.col("sig").alias("y"))).where("a < b")
    want = {(r["a"], r["b"]): r["r"] for r in every.select("a", "b", matching.match_reason(F.col("x"), F.col("y"), by_document).alias("r")).where("r <> ''").collect()}
    assert _pairs(df, by_document=by_document) == want and len(set(want.values())) >= 5


def test_evaluate_takes_the_last_match(spark):
    full = {"type": "paragon", "date": "d", "contractor": "c", "amount": "1", "currency": "PLN"}
    archive = spark.createDataFrame([record(1, "A"), record(2, "A", meta=full), record(3, "B"), record(4, "B", meta={"amount": "kwota-nieznana"})], SCHEMA)
    new = spark.createDataFrame([record(1, "A", meta=full), record(2, "B", meta=full), record(3, "Z"), record(4, None)], SCHEMA)
    got = {r["seq"]: (r["action"], r["reason"], r["match_seq"]) for r in matching.evaluate(new, archive).collect()}
    assert got == {1: ("duplicate", "document", 2), 2: ("supersede", "document", 4), 3: ("new", "", None), 4: ("new", "", None)}
    assert {r["action"] for r in matching.evaluate(new, archive.limit(0)).collect()} == {"new"} and matching.evaluate(new.limit(0), archive).count() == 0


def test_metadata_at_the_top(spark):
    df = spark.createDataFrame([(1, "A", "99", "2025", "c", "t")], "seq long, document_key string, amount string, date string, contractor string, type string")
    s = matching.signatures(df).first()["sig"]
    assert s["completeness"] == 5 and s["key"]["amount"] == "99" and s["key"]["currency"] == ""


def test_reconcile(spark):
    a, b = {"type": "paragon", "date": "2025-01-01", "contractor": "DUO CAFE", "amount": "kwota-nieznana", "currency": "PLN"}, {"type": "dokument", "date": "2025-01-01", "contractor": "unknown", "amount": "30.26", "currency": "PLN"}
    rows = [
        record(1, "A", dhash="949cacece898bcdc", phash="0f0f0f0f0f0f0f0f", meta=a), record(2, "B", dhash="949cdcecec98bcdc", phash="0f0f0f0f0f0f0f0e", meta=b), record(3, "C", dhash="ffffffffffffffff", phash="123456789abcdef0"),
        record(10, "X", {"number": "1", "auth": "2"}), record(11, "Y", {"time": "101010", "card": "4"}), record(12, "Z", {"number": "1", "auth": "2", "time": "101010", "card": "4"}), record(20, "S"), record(21, "S"),
    ]
    got = {r["group_seq"]: r for r in reconcile.reconcile(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {1, 10} and got[1]["keep"] == "A" and got[1]["drop"] == ["B"] and got[1]["reason"] == "visual-strong"
    assert got[1]["merged"]["amount"] == "30.26" and got[1]["merged"]["contractor"] == "DUO CAFE"
    assert got[10]["keep"] == "X" and got[10]["drop"] == ["Y", "Z"] and got[10]["reason"] == "visual"  # the first two are linked by the third
    assert {(r["seq"], r["keep_seq"]) for r in reconcile.supersessions(spark.createDataFrame(rows, SCHEMA)).collect()} == {(2, 1), (11, 10), (12, 10)}
    assert reconcile.reconcile(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fusion(spark):
    rows = [("a", 1, 0.5, {"x": " v1 ", "y": None, "z": "-"}), ("a", 2, 0.5, {"x": "V1", "y": "filled"}), ("a", 3, 0.6, {"x": "other", "z": "unknown"}), ("b", 1, 0.0, {"x": "p"}), ("b", 2, 0.0, {"x": "q"}), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "cluster string, seq int, weight double, fields map<string,string>")
    got = {(r["cluster"], r["field"]): r for r in fusion.merge_records(df).collect()}
    assert got["a", "x"]["value"] == " v1 " and got["a", "x"]["support"] == 2 and got["a", "x"]["candidates"] == 2 and got["a", "x"]["weight"] == 1.0 and got["a", "x"]["filled_gap"]
    assert got["a", "y"]["value"] == "filled" and got["a", "y"]["filled_gap"] and got["a", "z"]["value"] == "unknown" and got["a", "z"]["support"] == 0 and not got["a", "z"]["filled_gap"]
    assert got["b", "x"]["value"] == "p" and len(got) == 4 and got["b", "x"]["weight"] == 0.0001
    assert fusion.merge_records(df.limit(0)).count() == 0
    m = {r["cluster"]: r for r in fusion.merged(df).collect()}
    assert m["a"]["fields"]["y"] == "filled" and m["a"]["filled_gaps"] == ["x", "y"]


def test_nearest_against_all(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]

    def some(i):
        def one():
            h = rng.choice(base)
            for b in rng.sample(range(64), rng.randrange(6)):
                h ^= 1 << b
            return rng.choice([f"{h:016x}"] * 4 + [None])

        return (i, one(), one())

    a, b = [some(i) for i in range(60)], [some(i) for i in range(90)]
    dist = lambda x, y: None if x is None or y is None else (int(x, 16) ^ int(y, 16)).bit_count()
    want = {}
    for i, d1, p1 in a:
        near = [(min(ds), j) for j, d2, p2 in b if (ds := [x for x in (dist(d1, d2), dist(p1, p2)) if x is not None]) and max(ds) <= 6]
        if near:
            want[i] = min(near)
    A, B = (spark.createDataFrame(x, "seq long, dhash string, phash string") for x in (a, b))
    assert {r["seq"]: (r["distance"], r["match_seq"]) for r in nearest.best_match(A, B).collect()} == want and len(want) > 10
    ranked = nearest.rank_against(A.where("seq = 0"), B).orderBy("place").collect()
    assert len(ranked) == 90 and [r["distance"] for r in ranked] == sorted(r["distance"] for r in ranked)


def test_candidates_grow_in_proportion(spark):
    """Records without a common field and with random hashes: what the keys bring together is next to nothing, at ten times the rows too."""

    def tested(n):
        rng = random.Random(n)
        rows = [record(i, f"D{i}", {"number": str(i), "card": str(i % 500)}, f"{rng.getrandbits(64):016x}", f"{rng.getrandbits(64):016x}") for i in range(n)]
        k = matching.signatures(spark.createDataFrame(rows, SCHEMA)).select("seq", F.inline(matching.block_keys(F.col("sig"))))
        return k.groupBy("test", "key").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]

    few, many = tested(1500), tested(15_000)
    assert many < 0.5 * 15_000 * 15_000 / 2 / 100 and few < 1500 * 4 and many < 15_000 * 20


def test_band_combinations(spark):
    """Any hash at most ``most`` bits away shares a key of several bands."""
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), 6):
            b ^= 1 << bit
        pairs.append((f"{a:016x}", f"{b:016x}"))
    from idloom.functions import hashing as H

    df = spark.createDataFrame(pairs, "a string, b string")
    shared = df.select(F.size(H.bands(F.col("a"), 6, 3)).alias("keys"), F.size(F.array_intersect(H.bands(F.col("a"), 6, 3), H.bands(F.col("b"), 6, 3))).alias("n")).collect()
    assert all(r["keys"] == 84 and r["n"] > 0 for r in shared)


def test_best_match_broadcasts_no_keys(spark):
    """Key rows, up to 56 for a record, aren't broadcast, however small Spark takes the records for."""
    d = spark.createDataFrame([(i, f"{i * 977:016x}", None) for i in range(50)], "seq long, dhash string, phash string")
    assert "Broadcast" not in nearest.best_match(d, d)._jdf.queryExecution().executedPlan().toString()


def test_pairs_by_values_are_not_shuffled(spark):
    """Of n records of one business key all n * (n - 1) / 2 pairs match: no exchange has them, and components take fewer edges than nodes of each task."""
    from idloom.operators.components import components, forest

    m = {"type": "paragon", "date": "2025-01-01", "contractor": "DUO", "amount": "30.26", "currency": "PLN"}
    n = 300
    pairs = matching.blocked_pairs(spark.createDataFrame([record(i, f"D{i}", text="1,11 2,22 3,33", meta=m) for i in range(n)], SCHEMA), by_document=False)
    links = forest(pairs.select(F.col("seq_new").alias("a"), F.col("seq_old").alias("b")))
    assert pairs.count() == n * (n - 1) // 2 and links.count() == n - 1
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert sorted(components(forest(df)).collect()) == sorted(components(df).collect())
