from __future__ import annotations

import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from idloom.operators import compare
from idloom.plans import pipeline
from idloom.sources import files, images, ocr


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.TXT").write_bytes("Zażółć".encode() + b"\xff!")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "in/c.exe").write_bytes(b"x")
    (tmp_path / "in/d.html").write_text("<p>15.01.2025</p>")
    f = files.scan(spark, str(tmp_path))
    got = {r["source_file"].rsplit("/", 1)[1]: r for r in files.texts(f).collect()}
    assert got["a.TXT"]["full_text"] == "Zażółć!" and got["a.TXT"]["error"] is None and got["b.pdf"]["error"] == "needs OCR" and "unsupported" in got["c.exe"]["error"]
    assert files.scan(spark, str(tmp_path), files.TEXT, recursive=False).count() == 1
    out = pipeline.process_batch(files.read_texts(spark, str(tmp_path)), order="source_file")
    assert {r["document_date"] for r in out.collect()} == {None, "15.01.2025"}
    ids = {r["source_file"].rsplit("/", 1)[1]: r for r in files.file_ids(f).collect()}
    assert ids["c.exe"]["document_id"].startswith("UNIV-EXE-") and ids["c.exe"]["content_hash"] == hashlib.sha256(b"x").hexdigest()[:16] and ids["b.pdf"]["document_id"].startswith("UNIV-PDF-")
    files.write_json(pipeline.record(out), str(tmp_path / "out"))
    rows = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert len(rows) == 2 and "duplicate_of" in rows[0]
    assert len(json.loads(files.as_json_array(out.select("source_file", "document_id"), "source_file").first()[0])) == 2


def test_compare(spark):
    f = spark.createDataFrame([(1, "PDF", 5, "h", "t"), (2, "PDF", 6, "h", None), (3, "PNG", 5, "g", "t")], "key long, file_type string, file_size long, content_hash string, text_hash string")
    got = {(r["a"], r["b"]): r for r in compare.compare_files(spark.createDataFrame([(1, 2), (1, 3), (1, 1), (1, 9)], "a long, b long"), f).collect()}
    assert len(got) == 3 and got[1, 2]["same_type"] and not got[1, 2]["same_size"] and got[1, 2]["same_text_hash"] is None and got[1, 3]["same_text_hash"] and got[1, 1]["identical_ids"] and got[1, 1]["same_visual_hash"] is None
    d = compare.canonical_diff(spark.createDataFrame([(1, "a|b", "a|c|d|e|f|g")], "k int, x string, y string"), "x", "y", ["k"]).orderBy("position").collect()
    assert [(r["label"], r["value1"], r["same"]) for r in d] == [("NIP", "a", True), ("Numer", "b", False), ("Data", "BRAK", False), ("Kwota", "BRAK", False), ("Dodatkowe", "BRAK", False), ("Pole 6", "BRAK", False)]
    p = spark.range(1).select(compare.parse_file_identity(F.lit("UNIV-PDF-1")), compare.parse_file_identity(F.lit("x"))).first()
    assert p[0]["type_code"] == "PDF" and p[1] is None


class _Fake:
    def pages(self, pdf):
        return pdf.split(b"\f") if pdf else []

    def words(self, image):
        return [ocr.Word(w, 90.0 if w != "?" else -1.0, i // 2, (i, 0, i + 1, 1)) for i, w in enumerate(image.decode().split(" "))]


class _Missing:
    def __init__(self):
        raise ImportError("not here")


def test_recognise_and_combine(spark):
    f = spark.createDataFrame([("x.pdf", ".pdf", bytearray(b"a b c d\fe ?")), ("y.png", ".png", bytearray(b"NIP 5213017228")), ("z.pdf", ".pdf", bytearray(b""))], "source_file string, suffix string, content binary")
    pages = ocr.recognise(f, "tesseract", engines={"tesseract": _Missing, "paddle": _Fake})
    got = {(r["source_file"], r["page"]): r for r in pages.collect()}
    assert got["x.pdf", 1]["full_text"] == "a b\nc d" and got["x.pdf", 1]["engine_used"] == "paddle" and abs(got["x.pdf", 2]["average_confidence"] - 0.45) < 1e-9 and "no pages" in got["z.pdf", 1]["error"]
    whole = {r["source_file"]: r for r in ocr.combine_pages(pages.where("error is null")).collect()}
    assert whole["x.pdf"]["full_text"] == "a b\nc d\n\ne ?" and whole["x.pdf"]["n_pages"] == 2
    assert {r["source_file"]: r["nips"] for r in ocr.combine_entities(pages.where("error is null")).collect()}["y.png"] == ["5213017228"]
    w = spark.createDataFrame([(1, i, n, t, c) for i, (n, t, c) in enumerate([(1, "a", 90.0), (1, " ", 5.0), (1, "b", -1.0), (2, "c", 50.0), (1, "d", None), (None, "e", 10.0)])], "k int, seq int, line_num int, text string, conf double")
    assert [(r["text"], round(r["confidence"], 3)) for r in ocr.group_words(w, ["k"]).orderBy("line").collect()] == [("a b", 0.45), ("c", 0.5), ("d", 0.0), ("e", 0.1)]


def _picture(seed, noise=0):
    rng = random.Random(seed)
    img = np.full((64, 48), 255, np.uint8)
    img[4:10, 4:44] = 30
    for i in range(8):
        img[16 + 5 * i : 19 + 5 * i, 4 : 4 + rng.randrange(8, 40)] = rng.randrange(120)
    if noise:
        img = np.clip(img.astype(int) + np.random.default_rng(seed).integers(-noise, noise, img.shape), 0, 255).astype(np.uint8)
    return img


def test_fingerprints_of_images(spark, tmp_path):
    ham = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    a, n, other = (images.fingerprint(p) for p in (_picture(1), _picture(1, 12), _picture(9)))
    assert ham(a[1], n[1]) <= 6 and ham(a[2], n[2]) <= 6 and ham(a[2], other[2]) > 6 and len(a[0]) == 16
    assert images.hex_of([1, 1, 1]) == "7" and images.hex_of([1] * 5) == "1f" and images.exact_hash(_picture(1)) == images.exact_hash(_picture(1)) != images.exact_hash(_picture(9))
    assert images.resample(_picture(1), 48, 64).tolist() == _picture(1).tolist() and images.stretch(np.full((4, 4), 7, np.uint8)).tolist() == [[7] * 4] * 4
    rows = [("a", 48, 64, 1, bytearray(_picture(1).tobytes())), ("bad", 5, 5, 1, bytearray(b"x")), ("none", 0, 0, 1, None)]
    df = spark.createDataFrame(rows, "source_file string, width int, height int, channels int, data binary")
    got = {r["source_file"]: r for r in images.fingerprints(df).collect()}
    assert got["a"]["phash"] == a[2] and (got["a"]["width"], got["a"]["height"]) == (48, 64) and got["bad"]["phash"] is None and got["none"]["dhash"] is None
    feats = images.image_features(df.where("source_file = 'a'"), spark.createDataFrame([("a", 99)], "source_file string, file_size long")).first()
    assert feats["dimensions"] == "(48, 64)" and len(feats["content_hash"]) == 16
    assert images.preprocess(_picture(1)).shape == (64, 48)


def test_png_is_decoded_by_spark(spark, tmp_path):
    import struct
    import zlib

    img = _picture(3)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 48, 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in img))) + chunk(b"IEND", b"")
    (tmp_path / "p.png").write_bytes(png)
    r = images.fingerprints(images.read_images(spark, str(tmp_path))).first()
    assert tuple(r)[1:4] == images.fingerprint(img)[:3]


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file of one row group is cut into many partitions by its bytes, of which one has all the rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 900_000
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"k": np.random.default_rng(1).integers(0, 1 << 62, n)}), path, row_group_size=n, compression="none")
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= cores
        sizes = [r["count"] for r in files.spread(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(sizes) == n and max(sizes) <= files.TASK_ROWS and len(sizes) >= cores
