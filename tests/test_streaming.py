from __future__ import annotations

from pyspark.sql import functions as F

from idloom.streaming import online
from tests.test_matching import SCHEMA, record
from tests.test_pipeline import INVOICE, NOTE


def _run(stream, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return stream.sparkSession.table(q.name).collect()


def test_process_stream(spark, tmp_path):
    spark.createDataFrame([(1, INVOICE), (2, NOTE), (3, None)], "seq long, full_text string").write.parquet(str(tmp_path / "in"))
    got = {r["seq"]: r["document_id"] for r in _run(online.process_stream(spark.readStream.schema("seq long, full_text string").parquet(str(tmp_path / "in"))), tmp_path)}
    assert got[1] == "DOC-FV-F0BE35240C77B2DB" and len(got) == 3


def test_flag_duplicates_keeps_the_first(spark, tmp_path):
    kind = "canonical_string string, document_id string, seq long"
    for i, rows in enumerate([[("c", "A", 1), ("c", "B", 2), ("d", "D", 3)], [("c", "A", 4), ("c", "C", 5)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b={i}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {r["seq"]: (r["is_duplicate"], r["duplicate_of"]) for r in _run(online.flag_duplicates(stream), tmp_path)}
    assert got == {1: (False, None), 2: (True, "A"), 3: (False, None), 4: (False, None), 5: (True, "A")}


def test_decisions_batch_by_batch(spark, tmp_path):
    full = {"type": "paragon", "date": "d", "contractor": "c", "amount": "1", "currency": "PLN"}
    archive, told = str(tmp_path / "archive"), str(tmp_path / "told")
    one = spark.createDataFrame([record(1, "A"), record(2, "A", meta=full), record(3, "B")], SCHEMA)
    two = spark.createDataFrame([record(4, "B"), record(5, "C")], SCHEMA)
    for n, b in ((0, one), (0, one), (1, two)):  # a batch that is repeated changes nothing
        online.decide_batch(b, archive, told, n)
    got = {r["seq"]: (r["action"], r["match_seq"]) for r in spark.read.parquet(told).collect()}
    assert got == {1: ("new", None), 2: ("supersede", 1), 3: ("new", None), 4: ("duplicate", 3), 5: ("new", None)}
    assert sorted(r[0] for r in spark.read.parquet(archive).select("seq").collect()) == [1, 2, 3, 5]
    assert online.first_of_batch(spark.createDataFrame([("c", 2), ("c", 1)], "canonical_string string, seq int")).select(F.max("seq")).first()[0] == 1
