from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from idloom.functions import entities as E
from idloom.functions import hashing as H
from idloom.functions import normalize as N
from idloom.operators import ids


def apply(spark, values, *functions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", *[f(F.col("v")).alias(f"o{j}") for j, f in enumerate(functions)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(functions) > 1 else r[1] for r in rows]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (N.tax_number, {"521-301-72-28": "5213017228", "521 301 72 28": "5213017228", "PL5213017228": "5213017228", "pl 521.301.72.28": "5213017228", " PL1": "PL1", "": "", None: ""}),
        (N.is_tax_number, {"5213017228": True, "1234567890": False, "123456789": False, "12345678901": False, None: False, "abcdefghij": False}),
        (N.amount, {"1230.5": "1230.50", "1230,50 zł": "1230.50", "1 230 500,00": "1230500.00", "1230.555": "1230.56", "1230.554": "1230.55", "1,230.50": "1230.50", "1.230.500": "1230.50", "-1230.565": "-1230.57", "abc": "0.00", "": "0.00", None: "0.00", "1E10": "10000000000.00", "9" * 30: "0.00", "NaN": "0.00"}),
        (N.iso_date, {"15.01.2025": "2025-01-15", "15-1-2025": "2025-01-15", "15/01/2025": "2025-01-15", "5  1 2025": "2025-01-05", "20250115": "2025-01-15", "2025/1/5": "2025-01-05", "2025-13-45": "2025-13-45", "2025-01-15 12:30": "2025-01-15", "31.02.2025": "2025-02-31", "15.01.25": "15.01.25", " x ": "x", "": "", None: "", "7 of 123 in 2025": "2025-123-07"}),
        (N.document_number, {"fv/2025/00142": "FV/2025/00142", "FV 2025 142": "FV/2025/142", "fv_2025--00142/": "FV/2025/00142", "//": "", None: ""}),
        (N.printed_amount, {"1.234.5": "", "12,34 zł": "12.34", "1 234,56": "1234.56", "-5,00": "5.00", "": "", None: ""}),
        (N.printed_date, {"on 2025-01-15.": "2025-01-15", "15.01.2025": "2025-01-15", "15/01/25": "2025-01-15", "none": "none", None: ""}),
        (N.plain_text, {"Zażółć  gęślą — ŁÓDŹ ﬁn 12,50!": "zazoc gesla odz fin 12,50", None: "", "漢字": ""}),
        (H.veiled_name, {" jan ": "8ff23e3d", "": None, None: None}),
    ],
)
def test_tables(spark, f, cases):
    got = dict(zip(cases, apply(spark, list(cases), f), strict=True))
    if f is H.veiled_name:
        import hashlib

        cases = {k: v and hashlib.md5(b"JAN").hexdigest()[:8] for k, v in cases.items()}
    assert got == cases


def test_numbers_and_dates_as_columns(spark):
    r = spark.sql("select 1230.5d a, 1230.555d b, 7 c, date'2025-01-15' d, timestamp_ntz'2025-01-15 10:00:00' e").select(N.amount(F.col("a")), N.amount(F.col("b")), N.amount(F.col("c")), N.iso_date(F.col("d")), N.iso_date(F.col("e"))).first()
    assert tuple(r) == ("1230.50", "1230.56", "7.00", "2025-01-15", "2025-01-15")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="0123456789abPLzł.,-/ _ \n", max_size=14), min_size=20, max_size=40))
def test_normalisers_are_idempotent(spark, values):
    for f in (N.tax_number, N.amount, N.document_number, N.plain_text):
        once = apply(spark, values, f)
        if f is not N.tax_number:  # a second country code would go, too
            assert apply(spark, once, f) == once


def test_hamming_and_bands(spark):
    import random

    rng = random.Random(3)
    pairs = [("949cacece898bcdc", "949cdcecec98bcdc", 4), ("61616151233b0178", "416060502a0a4078", 11), ("ff00", "ff01", 1), ("0000", "ffff", 16), ("0" * 32, "f" * 32, 128), ("zz", "zz", None), ("ff", "fff", None), (None, "ff", None), ("", "", None)]
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(9)):
            b ^= 1 << bit
        pairs.append((f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()))
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    shared = F.size(F.array_intersect(H.bands(F.col("a"), 6), H.bands(F.col("b"), 6)))
    rows = df.select("d", H.hamming(F.col("a"), F.col("b")).alias("h"), shared.alias("n"), F.length("a").alias("len"), H.distance_or_far(F.col("a"), F.col("b")).alias("far"), H.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert r["h"] == r["d"] and r["far"] == (999 if r["d"] is None else r["d"])
        assert r["s"] == (None if r["d"] is None else 1 - r["d"] / (4 * r["len"]))
        assert r["d"] is None or r["len"] != 16 or r["d"] > 6 or r["n"] > 0


def test_identities(spark):
    lit = F.lit
    one = ids.document_id("FV", ids.invoice(lit("521-301-72-28"), lit("fv/2025/00142"), lit("15.01.2025"), lit("1 230,50 zł")))
    two = ids.document_id("FV", ids.invoice(lit("5213017228"), lit("FV/2025/00142"), lit("2025-01-15"), lit(1230.50)))
    par = ids.document_id("PAR", ids.receipt(lit("5213017228"), lit("2025-01-15"), lit("37.88"), None, lit("001")))
    umo = [ids.document_id("UMO", ids.contract(lit(a), lit(b), lit("2025-01-15"), lit("001/2025"))) for a, b in (("5213017228", "1234567890"), ("1234567890", "5213017228"))]
    clash = [ids.receipt(lit("1"), lit("2"), lit("3"), number, register) for number, register in ((lit("X"), lit(None)), (None, lit("X")))]
    r = spark.range(1).select(one, two, par, *umo, *clash, ids.verify(one, ids.invoice(lit("5213017228"), lit("FV/2025/00142"), lit("2025-01-15"), lit("1230.5"))), ids.parse(lit("DOC-XX-1")), ids.parse(lit("invalid-id")), ids.parse(lit("DOC-FV-1"))["document_type"]).first()
    assert r[0] == r[1] == "DOC-FV-F0BE35240C77B2DB" and r[2] == "DOC-PAR-8142B3FC69D7778C" and r[3] == r[4] == "DOC-UMO-C54CB968D1342642"
    assert r[5] == r[6] and r[7] is True and r[8]["document_type"] is None and r[8]["type_code"] == "XX" and r[9] is None and r[10] == "INVOICE"


def test_payment_trace(spark):
    texts = ["PARAGON nr 181149\nautoryzacji: 784683 o 9:52:51\n1671 wazna do 12/29, 2026-06-19", "nr 12 bez", None, "15.01.2026 7:05"]
    got = [tuple(x) for x in apply(spark, texts, E.payment_trace)]
    assert got == [("181149", "784683", "095251", "1671", "20260619095251"), ("", "", "", "", None), ("", "", "", "", None), ("", "", "", "", "202601150705")]


def test_entities_in_order(spark):
    t = "NIP: 521-301-72-28, 5213017228 i 123-456-78-90. Suma: 1230,50 zł, brutto: 999,99; <IssueDate>2025-02-01</IssueDate> 15.01.2025 2023/06/29"
    n, a, d, nums = apply(spark, [t, None], E.tax_numbers, E.amounts, E.dates, E.document_numbers)[0]
    assert n == ["5213017228"] and "1230.50" in a and "999.99" in a and d[:2] == ["2025-02-01", "15.01.2025"] and "2023/06/29" not in d and len(set(nums)) == len(nums)
    assert apply(spark, [None], E.tax_numbers, E.amounts)[0] == ([], [])


def test_a_computed_value_is_computed_once(spark):
    """Whatever uses a matched text, each pattern is in the plan once for it: in branches Spark computes a value anew for each use."""
    t = F.col("t")
    for c, pattern, most in ((N.printed_date(F.regexp_extract(t, "x(.*)y", 1)), "x(.*)y", 1), (E.first_match(t, "x(.*)y"), "x(.*)y", 1), (N.printed_amount(F.regexp_extract(t, "x(.*)y", 1)), "x(.*)y", 1)):
        plan = spark.createDataFrame([("x2024-05-02y",)], "t string").select(c.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count(pattern) <= most
