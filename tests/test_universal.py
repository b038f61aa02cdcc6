"""Files of every kind to features and IDs; SQL functions; exports."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

import idloom
from idloom.operators import compare, ids, reports
from idloom.sources import images, pdf, universal


def _pdf(*pages, compress=False, objstm=False):
    """A PDF file with a page for each content stream."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 4: b"<< /Type /Font /BaseFont /Helvetica >>", 5: b"<< /Title (A \\(small\\) file) /Author (N) >>", 6: b"<< /Type /XObject /Subtype /Image /Width 1 >>\nstream\nx\nendstream"}
    kids = []
    for i, content in enumerate(pages):
        n = 10 + 2 * i
        kids.append(b"%d 0 R" % n)
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 4 0 R >> /XObject << /I 6 0 R >> >> >>" % (n + 1)
        data = zlib.compress(content) if compress else content
        objects[n + 1] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if compress else b"", data)
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 595.28 841.89] >>" % (b" ".join(kids), len(kids))
    if objstm:
        inner = {n: objects.pop(n) for n in (1, 2, 4)}
        body, head = b"", b""
        for n, b in inner.items():
            head += b"%d %d " % (n, len(body))
            body += b + b" "
        data = zlib.compress(head + body)
        objects[99] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(inner), len(head), data)
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R /Info 5 0 R >>\n%%EOF"


ONE, TWO = b"BT /F1 12 Tf 10 10 Td (Faktura \\(1\\)) Tj T* <4e4950> Tj ET 0 0 m 5 5 l S 1 1 3 3 re f", b"BT (Strona S f) Tj ET"


@pytest.mark.parametrize("how", [{}, {"compress": True}, {"compress": True, "objstm": True}])
def test_pdf_pages(how):
    d = pdf.read_bytes(_pdf(ONE, TWO, **how))
    assert [(p.text.strip(), p.images, p.width, p.height, p.drawings, p.fonts) for p in d.pages] == [("Faktura (1)\nNIP", 1, 595.28, 841.89, 2, 1), ("Strona S f", 1, 595.28, 841.89, 0, 1)]
    assert d.metadata == {"Title": "A (small) file", "Author": "N"}
    assert pdf.hashes(d) == pdf.hashes(pdf.read_bytes(_pdf(ONE, TWO)))


def test_pdf_without_pages():
    with pytest.raises(ValueError):
        pdf.read_bytes(b"text")
    content, text, meta, visual, size, n = pdf.hashes(pdf.read_bytes(b"%PDF-1.4"))
    assert (text, visual, size, n) == (None, None, None, 0) and content == pdf._sha("") and meta == pdf._sha("{}")


def _png(w, h, gray):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    rows = b"".join(b"\0" + bytes((x * 7 + y * gray) % 256 for x in range(w)) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_files_of_every_kind(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.pdf": _pdf(ONE, TWO), "sub/A2.PDF": _pdf(ONE, TWO), "bad.pdf": b"no", "p.png": _png(20, 10, 3), "bad.PNG": b"no", "t.txt": b"text", "none": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    f = universal.file_features(spark, str(tmp_path)).cache()
    got = {r["source_file"].split("/")[-1]: r for r in f.collect()}
    assert sorted(got) == sorted(["a.pdf", "A2.PDF", "bad.pdf", "p.png", "bad.PNG", "t.txt", "none"])
    assert {n for n, r in got.items() if r["error"]} == {"bad.pdf", "bad.PNG"} == {n for n, r in got.items() if r["document_id"] is None}
    a, b, p, t = (got[n] for n in ("a.pdf", "A2.PDF", "p.png", "t.txt"))
    assert a["page_count"] == 2 and a["dimensions"] == "(595.28, 841.89)" and a["content_hash"] == b["content_hash"] and a["document_id"].startswith("UNIV-PDF-")
    assert p["document_id"].startswith("UNIV-IMG-") and p["dimensions"] == "(20, 10)" and p["visual_hash"] and t["document_id"].startswith("UNIV-TXT-")
    claims = spark.createDataFrame([(r["source_file"], i) for r in got.values() for i in (r["document_id"], "UNIV-PDF-0")] + [("gone", a["document_id"])], "source_file string, claimed_id string")
    right = {(r["source_file"].split("/")[-1], r["claimed_id"]) for r in universal.verify_files(f, claims).where("verified").collect()}
    assert right == {(n, r["document_id"]) for n, r in got.items() if r["document_id"]}
    assert universal.file_features(spark, str(tmp_path / "sub")).count() == 1


def test_sql_functions(spark):
    names = idloom.register(spark, "x_")
    assert "x_invoice_id" in names
    got = spark.sql("""SELECT x_invoice_id('521-301-72-28', 'fv/2025/00142', '15.01.2025', '1 230,50 zł') AS a, x_is_valid_nip('1234567890') AS v, x_normalize_date('15.01.2025') AS d, x_normalize_amount('1 230,5') AS m,
      x_receipt_id('5213017228', '2025-01-15', '45.99', NULL, '001') AS r, x_hash_distance('949cacece898bcdc', '949cdcecec98bcdc') AS h, x_id_type_code('DOC-FV-1') AS t, x_id_type_code('no') AS n, x_verify_id('DOC-FV-X', 'a') AS q""").first()
    lit = F.lit
    want = spark.range(1).select(ids.document_id("FV", ids.invoice(lit("5213017228"), lit("FV/2025/00142"), lit("2025-01-15"), lit("1230.50"))), ids.document_id("PAR", ids.receipt(lit("5213017228"), lit("2025-01-15"), lit("45.99"), lit(None).cast("string"), lit("001")))).first()
    assert (got["a"], got["r"]) == tuple(want) and (got["v"], got["d"], got["m"], got["h"], got["t"], got["n"], got["q"]) == (False, "2025-01-15", "1230.50", 4, "FV", None, False)


def test_exports():
    assert all(callable(getattr(idloom, n)) or n == "TYPES" for n in idloom.__all__) and idloom.compare_files is compare.compare_files
    with pytest.raises(AttributeError):
        idloom.nothing  # noqa: B018


def test_small_reports_and_fingerprints(spark):
    df = spark.createDataFrame([(["b", "a"],), (list("abcdef"),)], "x array<string>")
    assert [r[0] for r in df.select(reports.listed(F.col("x"))).collect()] == ["a, b", "6 unique IDs"]
    df = spark.createDataFrame([('{"ahash": "ff", "width": 3, "quality_score": 0.123456}',), ("{}",)], "j string").select(images.from_json(F.col("j")).alias("f")).select("f.*")
    a, b = images.rounded(df).collect()
    assert (a["ahash"], a["width"], a["quality_score"], a["dhash"]) == ("ff", 3, 0.1235, "") and (b["width"], b["contrast"], b["phash"]) == (0, 0.0, "")
