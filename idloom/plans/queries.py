"""One query for each operator, over whole tables of the driver. ``QUERIES`` by name; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import hashing as H
from ..functions import normalize as N
from ..operators import classify, compare, fusion, ids, matching, nearest, reconcile, reports
from ..sources import files, images, ocr
from . import inputs, pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
c = F.col


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return files.spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def business(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.spark_input(spark, sf, inputs.BUSINESS)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.spark_input(spark, sf, inputs.TEXTS)


def archive(spark: SparkSession, sf: str, sql: str = inputs.ARCHIVE) -> DataFrame:
    r = inputs.spark_input(spark, sf, sql)
    five = [f"m_{f}" for f in matching.RECORD_FIELDS]
    r = r.withColumn("fingerprint", F.struct(*[c(f"f_{f}").alias(f) for f in (*matching.TRACE_FIELDS, "datetime")]))
    r = r.withColumn("metadata", F.when(c("nested"), F.struct(*[c(f).alias(f[2:]) for f in five])))
    return r.withColumns({f[2:]: F.when(~c("nested"), c(f)) for f in five}).drop(*five, *[x for x in r.columns if x.startswith("f_")], "nested")


def _joined(x: Column) -> Column:
    return F.array_join(x, "; ")


# identities

IDENTITIES: dict[str, tuple[str, Callable[[], Column]]] = {
    "invoice_id": ("FV", lambda: ids.invoice(c("nip_text"), c("number_text"), c("date_text"), c("amount_text"))),
    "bill_id": ("RAC", lambda: ids.bill(c("nip_text"), c("number_text"), c("date_text"), c("amount_text"))),
    "correction_id": ("KOR", lambda: ids.correction(c("nip_text"), F.concat(F.lit("kor "), c("no")), c("date_text"), c("number_text"), c("amount_text"))),
    "receipt_id": ("PAR", lambda: ids.receipt(c("nip_text"), c("date_text"), c("amount_text"), F.when(c("k") % 3 != 0, F.concat(F.lit(" nr "), c("no"))), F.when(c("k") % 2 == 0, c("dd")))),
    "contract_id": ("UMO", lambda: ids.contract(c("nip_text"), c("nip2_text"), c("date_text"), F.when(c("k") % 3 != 0, F.concat(F.lit("umo/"), c("no"))), F.when(c("k") % 4 == 0, F.lit("najem")))),
    "bank_statement_id": ("WB", lambda: ids.bank_statement(F.concat(F.lit("PL61 1090-"), c("nip")), c("date_text"), F.when(c("k") % 3 != 0, F.concat(F.lit(" s"), c("no"))))),
    "cash_in_id": ("KP", lambda: ids.cash(F.concat(F.lit(" kp/"), c("no")), c("date_text"), c("amount_text"), F.when(c("k") % 3 != 0, c("nip_text")), F.when(c("k") % 2 == 0, F.concat(F.lit("Jan "), c("no"))))),
    "cash_out_id": ("KW", lambda: ids.cash(F.concat(F.lit(" kw/"), c("no")), c("date_text"), c("amount_text"), F.when(c("k") % 3 != 0, c("nip_text")), F.when(c("k") % 2 == 0, F.concat(F.lit("Jan "), c("no"))))),
    "debit_note_id": ("NK", lambda: ids.debit_note(c("nip_text"), F.concat(F.lit("nk/"), c("no")), c("date_text"), c("amount_text"), F.when(c("k") % 3 != 0, c("nip2_text")))),
    "delivery_note_id": ("WZ", lambda: ids.delivery_note(c("nip_text"), F.concat(F.lit("wz/"), c("no")), c("date_text"), F.when(c("k") % 3 != 0, c("nip2_text")))),
    "expense_id": ("DEL", lambda: ids.expense_report(F.concat(F.lit(" emp "), c("ck")), c("date_text"), c("amount_text"), F.when(c("k") % 3 != 0, c("no")), F.when(c("k") % 2 == 0, c("nip_text")))),
}


def _identity(kind: str, canonical: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: ids.with_id(business(spark, sf), kind, canonical()).select("k", "canonical_string", "document_id")


for _name, (_kind, _canonical) in IDENTITIES.items():
    QUERIES[_name] = _identity(_kind, _canonical)


@query
def generic_id(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    canonical = ids.generic(H.content_hash(c("text")), F.when(c("doc_id") % 2 == 0, F.lit("2.5.2024")), F.when(c("doc_id") % 3 == 0, F.lit("PL521-301-72-28")))
    return d.select("doc_id", ids.document_id(F.when(c("doc_id") % 2 == 0, "PRO").otherwise("PZ"), canonical).alias("document_id"))


@query
def local_document_id(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("r", ids.local_fallback(F.when(c("doc_id") % 10 == 0, F.concat(F.lit("DOC-FV-"), c("doc_id"))), F.when(c("doc_id") % 3 == 0, c("source")).otherwise(c("text")), c("text")))
    return d.select("doc_id", "r.id", "r.provider", "r.source")


def _some_ids(spark: SparkSession, sf: str) -> DataFrame:
    claimed = F.when(c("k") % 5 == 0, F.concat(c("document_id"), F.lit("0"))).when(c("k") % 5 == 1, F.lit("no-id")).when(c("k") % 5 == 2, F.translate("document_id", "V", "Q")).otherwise(c("document_id"))
    return ids.with_id(business(spark, sf), "FV", ids.invoice(c("nip_text"), c("number_text"), c("date_text"), c("amount_text"))).withColumn("claimed", claimed)


@query
def id_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _some_ids(spark, sf).withColumn("p", ids.parse(c("claimed"))).select("k", "p.prefix", "p.type_code", "p.hash", "p.document_type")


@query
def id_verify(spark: SparkSession, sf: str) -> DataFrame:
    return _some_ids(spark, sf).select("k", ids.verify(c("claimed"), c("canonical_string")).alias("verified"))


# normalisers


@query
def nip_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return business(spark, sf).select("k", N.tax_number(c("nip_text")).alias("nip"), N.is_tax_number(c("nip_text")).alias("valid"))


@query
def amount_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return business(spark, sf).select("k", N.amount(c("amount_text")).alias("amount"), N.printed_amount(c("printed")).alias("printed_amount"))


@query
def date_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return business(spark, sf).select("k", N.iso_date(c("date_text")).alias("day"), N.printed_date(c("date_text")).alias("printed_day"))


@query
def number_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return business(spark, sf).select("k", N.document_number(c("number_text")).alias("number"))


@query
def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", N.plain_text(c("text")).alias("plain"))


# entities


@query
def find_entities(spark: SparkSession, sf: str) -> DataFrame:
    t = texts(spark, sf).withColumn("e", E.entities(c("full_text")))
    return t.select("seq", *[_joined(c(f"e.{n}")).alias(n) for n in ("nips", "amounts", "dates", "invoice_numbers")])


@query
def find_document_amounts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").unionByName(table(spark, sf, "pages").select(c("page_id").alias("doc_id"), c("html").alias("text")), allowMissingColumns=True)
    return d.select("doc_id", F.length("text").alias("n"), _joined(E.amounts(c("text"))).alias("amounts"), _joined(F.array_sort(E.money_tokens(c("text")))).alias("money"))


@query
def payment_traces(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).withColumn("f", E.payment_trace(c("full_text"))).select("seq", "f.*")


# classification and the pipeline


@query
def classify_texts(spark: SparkSession, sf: str) -> DataFrame:
    return classify.classify(classify.with_entities(texts(spark, sf))).select("seq", "scores.invoice", "scores.receipt", "scores.contract", "category")


@query
def extract_all(spark: SparkSession, sf: str) -> DataFrame:
    t = classify.with_entities(texts(spark, sf)).withColumn("average_confidence", F.lit(1.0))
    return classify.extract_all(t, ["seq"]).select("seq", "rank", "category", "confidence", "document_date", "issuer_nip")


@query
def process_documents(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.process(texts(spark, sf), "forced").select("seq", "category", "document_type", "canonical_string", "document_id", *classify.FIELDS)


def _processed(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.prior_duplicates(pipeline.process(texts(spark, sf), "forced"))


@query
def prior_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _processed(spark, sf).select("seq", "document_id", "is_duplicate", "duplicate_of")


@query
def process_batch(spark: SparkSession, sf: str) -> DataFrame:
    rejected = F.when(c("seq") % 50 == 7, F.lit("needs OCR"))
    return pipeline.process_batch(texts(spark, sf).withColumn("error", rejected), force_type="forced").select("seq", "document_id", "document_type", "canonical_string")


@query
def batch_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.totals(pipeline.record(_processed(spark, sf)))


@query
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.type_counts(pipeline.process(texts(spark, sf), "forced"))


@query
def batch_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(c("doc_id").alias("seq"), c("doc_id").cast("string").alias("source_file"), ids.document_id("DOC", ids.generic(H.content_hash(c("text")))).alias("document_id"))
    return reports.duplicates(d).withColumn("files", F.array_join("files", ","))


@query
def determinism(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.determinism(texts(spark, sf))


@query
def verify_documents(spark: SparkSession, sf: str) -> DataFrame:
    claimed = F.when(c("seq") % 2 == 0, F.lit("DOC-FV-0000000000000000")).otherwise(F.concat(F.lit("DOC-DOC-"), H.short_sha(F.concat_ws("|", H.content_hash(c("full_text"))))))
    return pipeline.verify(texts(spark, sf).withColumn("claimed_id", claimed)).select("seq", "verified")


@query
def engine_report(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").select(c("event_type").alias("engine"), c("user_id").cast("string").alias("document_id"), (c("value") % 1).alias("confidence"), c("value").alias("processing_time_ms"))
    return reports.engines(runs).select("engine", "n_runs", "n_ids", "deterministic", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("mean_ms", 6).alias("mean_ms"), "min_ms", "max_ms")


@query
def ids_by_category(spark: SparkSession, sf: str) -> DataFrame:
    found = pipeline.process(texts(spark, sf).where("full_text LIKE 'Notatka%' OR k < 40"), "forced")
    return found.groupBy("category").agg(reports.listed(F.collect_set("document_type")).alias("types"), reports.listed(F.collect_set("document_id")).alias("ids"))


# hashes


def _grids(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(c("vec_id").alias("seq"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.where(F.size("e") == 64)


def _hashes(spark: SparkSession, sf: str) -> DataFrame:
    after = lambda i: F.get("e", F.when(i == 63, 0).otherwise(i + 1))
    bit = lambda x: F.when(x, 1).otherwise(0)
    return _grids(spark, sf).select("seq", H.bits_to_hex(F.transform("e", lambda x: bit(x > 0))).alias("phash"), H.bits_to_hex(F.transform("e", lambda x, i: bit(x > after(i)))).alias("dhash"))


@query
def grid_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return images.grid_hashes(_grids(spark, sf), "seq", "e").select("seq", "ahash", "dhash")


@query
def grid_phash(spark: SparkSession, sf: str) -> DataFrame:
    return images.grid_hashes(_grids(spark, sf), "seq", "e").select("seq", "phash")


@query
def hamming(spark: SparkSession, sf: str) -> DataFrame:
    h = _hashes(spark, sf)
    p, d = c("phash"), c("dhash")
    return h.select("seq", H.hamming(p, d).alias("distance"), H.similarity(p, d).alias("similarity"), H.distance_or_far(p, F.left(d, F.lit(8))).alias("far"), H.looks_same(d, p, p, d, 40).alias("same"))


@query
def best_match(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.best_match(archive(spark, sf, inputs.CANDIDATES), archive(spark, sf))


@query
def visual_rank(spark: SparkSession, sf: str) -> DataFrame:
    h = _hashes(spark, sf)
    return nearest.rank_against(h.where("seq % 100 = 0"), h, 12)


# archive records


@query
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    s = matching.signatures(archive(spark, sf))
    return s.select("seq", "sig.completeness", F.concat_ws("|", "sig.key.contractor", "sig.key.date", "sig.key.amount", "sig.key.currency").alias("key"))


@query
def money_overlap(spark: SparkSession, sf: str) -> DataFrame:
    a = archive(spark, sf).select("seq", E.money_tokens(c("text")).alias("m"))
    b = a.select((c("seq") - 1).alias("seq"), c("m").alias("n"))
    return a.join(b, "seq").select("seq", E.money_overlap(c("m"), c("n")).alias("o")).select("seq", "o.shared", "o.jaccard")


@query
def match_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return matching.blocked_pairs(archive(spark, sf), by_document=False).select("seq_new", "seq_old", "reason")


@query
def find_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return matching.find_duplicates(archive(spark, sf, inputs.CANDIDATES), archive(spark, sf))


@query
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    return matching.evaluate(archive(spark, sf, inputs.CANDIDATES), archive(spark, sf))


@query
def reconcile_archive(spark: SparkSession, sf: str) -> DataFrame:
    r = reconcile.reconcile(archive(spark, sf))
    return r.select("group_seq", "keep", F.array_join("drop", ",").alias("drop"), "reason", *[c(f"merged.{f}").alias(f"m_{f}") for f in matching.RECORD_FIELDS])


@query
def supersessions(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.supersessions(archive(spark, sf))


@query
def merge_records(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem")
    last = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    one = s.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.max(last).alias("r"))
    word = lambda x: x.cast("string")
    fields = F.map_from_arrays(F.array(*[F.lit(f) for f in ("flag", "status", "line", "supplier")]), F.array(
        F.when(c("l_linenumber") % 3 == 0, F.lit("unknown")).otherwise(c("r.l_returnflag")), F.when(c("l_linenumber") % 2 == 0, F.lower("r.l_linestatus")).otherwise(c("r.l_linestatus")),
        F.when(c("l_linenumber") > 5, F.lit(None)).otherwise(word(c("l_linenumber") % 2)), word(c("l_suppkey") % 3)))
    seq = c("l_linenumber").cast("long") * 1_000_000_000_000 + c("l_partkey") * 1_000_000 + c("l_suppkey")
    return fusion.merge_records(one.select(c("l_orderkey").alias("cluster"), seq.alias("seq"), (c("l_linenumber") % 4 / 4.0).cast("double").alias("weight"), fields.alias("fields")))


# comparing files


def _files(spark: SparkSession, sf: str) -> DataFrame:
    content = F.encode("text", "UTF-8")
    d = table(spark, sf, "documents").select(c("doc_id").alias("key"), F.concat(F.lit("."), F.upper("lang")).alias("suffix"), F.octet_length("text").cast("long").alias("file_size"), content.alias("content"), F.when(c("doc_id") % 2 == 0, H.short_sha(c("text"))).alias("text_hash"))
    return d.withColumn("suffix", F.lower("suffix"))


@query
def universal_id(spark: SparkSession, sf: str) -> DataFrame:
    f = files.file_ids(_files(spark, sf)).withColumn("p", compare.parse_file_identity(c("document_id")))
    return f.select("key", "document_id", "p.type_code", "content_hash")


@query
def universal_verify(spark: SparkSession, sf: str) -> DataFrame:
    f = files.file_ids(_files(spark, sf))
    claimed = F.when(c("key") % 4 == 0, F.lower("document_id")).when(c("key") % 4 == 1, F.lit("UNIV-EN")).when(c("key") % 4 == 2, c("document_id"))
    return f.select("key", compare.verify_file_identity(claimed).alias("verified"))


@query
def compare_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    pairs = d.groupBy(c("text").alias("t")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).select("a", "b").unionByName(d.select(c("doc_id").alias("a"), (c("doc_id") + 1).alias("b")))
    return compare.compare_files(pairs, files.generic_features(_files(spark, sf)))


@query
def canonical_diff(spark: SparkSession, sf: str) -> DataFrame:
    b = business(spark, sf)
    one = ids.invoice(c("nip_text"), c("number_text"), c("date_text"), c("amount_text"))
    two = ids.receipt(c("nip"), c("day"), c("money"), c("no"), F.when(c("k") % 2 == 0, c("dd")))
    return compare.canonical_diff(b.select("k", one.alias("one"), two.alias("two")), "one", "two", ["k"])


# recognised text


@query
def ocr_lines(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "text"))
    w = w.select("conv_id", (c("turn") * 1_000_000 + c("i")).alias("seq"), F.floor(c("i") / 6 % 3).cast("int").alias("line_num"), "text", (c("i") % 101 - 1).alias("conf"))
    return ocr.group_words(w, ["conv_id"]).select("conv_id", "line", "text", F.round("confidence", 9).alias("confidence"))


@query
def page_combine(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "conversations").select("conv_id", c("turn").alias("page"), c("text").alias("full_text"), (c("turn") % 5 / 4.0).cast("double").alias("average_confidence"))
    return ocr.combine_pages(p, "conv_id").select("conv_id", "n_pages", "full_text", F.round("average_confidence", 9).alias("average_confidence"))
