from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from idloom.operators import classify, reports
from idloom.plans import pipeline

INVOICE = "FAKTURA VAT\nNumer dokumentu: FV/2025/00142\nData wystawienia: 2025-01-15\nSprzedawca NIP: 521-301-72-28\nNabywca NIP: 123-456-78-90\nRazem netto: 1 000,41\nDo wpłaty brutto: 1 230,50 zł"
INVOICE_XML = "<Invoice><InvoiceNumber>fv/2025/00142</InvoiceNumber><IssueDate>2025-01-15</IssueDate><NIP>5213017228</NIP>\nfaktura vat sprzedawca nabywca\n<TotalGrossAmount>1230.50</TotalGrossAmount></Invoice>"
RECEIPT = "PARAGON FISKALNY\nNR: 001/2025/000123\nDATA: 2025-01-15\nNIP: 521-301-72-28\nKasa: 001\nSUMA PTU: 7,08 PLN\nSUMA VAT: 8,08\nSUMA: 37,88 PLN\nGOTÓWKA: 50,00 PLN"
CONTRACT = "Umowa współpracy nr UMO/2025/001 zawarta w dniu 15.01.2025.\nWykonawca, NIP 521-301-72-28. Przedmiot umowy, wynagrodzenie, termin."
NOTE = "Zwykła notatka z dnia 15.01.2025"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, INVOICE, None), (1, INVOICE_XML, None), (2, RECEIPT, None), (3, CONTRACT, None), (4, NOTE, None), (5, None, None), (6, "", None), (7, NOTE, "PRO"), (8, INVOICE, "XX"), (9, INVOICE, None)]
    return spark.createDataFrame(rows, "seq int, full_text string, forced string")


def test_process(docs):
    got = {r["seq"]: r for r in pipeline.process_batch(docs, skip_duplicates=False, force_type="forced").collect()}
    assert got[0]["canonical_string"] == "5213017228|FV/2025/00142|2025-01-15|1230.50" and got[0]["document_id"] == got[1]["document_id"] == got[9]["document_id"] == "DOC-FV-F0BE35240C77B2DB"
    assert got[0]["net_amount"] == "1000.41" and got[0]["buyer_nip"] is None and got[1]["category"] == "invoice"
    assert got[2]["document_id"] == "DOC-PAR-3C4D9AF0329B2CE3" and got[2]["cash_register_number"] is None and got[2]["gross_amount"] == "37.88"
    assert got[3]["category"] == "contract" and got[3]["contract_type"] == "WSPOLPRACA" and got[3]["canonical_string"].startswith("|5213017228|2025-01-15|")
    assert got[4]["category"] == "unknown" and got[4]["document_type"] == "DOC" and got[4]["document_date"] == "15.01.2025"
    assert got[5]["document_id"] == got[6]["document_id"] and got[5]["category"] == "unknown"
    assert (got[7]["is_duplicate"], got[7]["duplicate_of"]) == (True, got[4]["document_id"]) and got[7]["document_id"][8:] == got[4]["document_id"][8:]
    assert got[8]["document_type"] == "XX" and not got[9]["is_duplicate"]


def test_batch_leaves_duplicates_and_errors_out(docs):
    with_error = docs.withColumn("error", F.when(F.col("seq") == 3, "no"))
    assert {r["seq"] for r in pipeline.process_batch(with_error, force_type="forced").select("seq").collect()} == set(range(10)) - {3, 7}


def test_extract_all_is_sorted(docs):
    rows = classify.extract_all(classify.with_entities(docs), ["seq"]).collect()
    for s in range(9):
        mine = sorted((r for r in rows if r["seq"] == s), key=lambda r: r["rank"])
        assert [r["confidence"] for r in mine] == sorted((r["confidence"] for r in mine), reverse=True) and all(r["confidence"] > 0.4 for r in mine)


def test_record_and_reports(spark, docs):
    out = pipeline.record(pipeline.process_batch(docs, skip_duplicates=False, force_type="forced"))
    assert out.columns == ["document_id", "document_type", "canonical_string", "ocr_confidence", "source_file", "is_duplicate", "duplicate_of", "extraction"]
    t = reports.totals(out).first()
    assert (t["n_documents"], t["n_duplicates"], t["mean_confidence"], t["all_same"]) == (10, 1, 1.0, False)
    assert reports.totals(out.limit(0)).first()["mean_confidence"] == 0.0
    runs = spark.createDataFrame([("b", "x", 0.5, 1.0), ("a", "x", 0.5, 3.0), ("a", "y", 0.5, 5.0)], "engine string, document_id string, confidence double, processing_time_ms double")
    assert reports.best_engine(runs).first()["engine"] == "a" and {r["engine"]: r["deterministic"] for r in reports.engines(runs).collect()} == {"a": False, "b": True}
    assert sorted(r["seq"] for r in reports.ends(docs, 2).collect()) == [0, 1, 8, 9]


def test_own_extractor(docs):
    note = classify.Extractor("note", lambda: F.when(F.col("full_text").contains("notatka"), 0.9).otherwise(0.0), lambda: {"document_date": F.lit("d")})
    got = {r["seq"]: (r["category"], r["document_date"]) for r in classify.extract(classify.with_entities(docs).withColumn("average_confidence", F.lit(1.0)), [*classify.EXTRACTORS, note]).collect()}
    assert got[4] == ("note", "d") and got[0][0] == "invoice"
