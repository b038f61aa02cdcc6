"""From recognised text to a document's identity, in one pass: entities, kind, fields, canonical string, ID, prior duplicates.

``process`` is a projection and runs on streams too; ``prior_duplicates`` needs the whole batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.hashing import content_hash
from ..operators import ids
from ..operators.classify import FIELDS, TYPE_OF, extract, with_entities
from ..scratch import written


def _type_of(force_type: str | None) -> Column:
    names = F.create_map(*[F.lit(x) for kv in TYPE_OF.items() for x in kv])
    mapped = F.coalesce(F.try_element_at(names, F.col("category")), F.lit("DOC"))
    return mapped if force_type is None else F.coalesce(N.present(F.col(force_type)), mapped)


def identify(df: DataFrame, force_type: str | None = None, prefix: str = ids.PREFIX) -> DataFrame:
    """Adds document_type, canonical_string and document_id to extracted rows. ``force_type`` names a column that overrules the kind.

    The canonical string is the one for display and for prior duplicates: it isn't always what is hashed. Invoices keep
    their number as printed, receipts their parts; a text of no known kind has 32 digits of its hash in it and 64 in the ID.
    """
    c = F.col
    sha = content_hash(c("full_text"))
    # once each, as several expressions below use them
    df = df.withColumns({
        "document_type": _type_of(force_type), "_nip": N.tax_number(c("issuer_nip")), "_other": N.tax_number(c("party2_nip")), "_day": N.iso_date(c("document_date")),
        "_gross": N.amount(F.coalesce(N.present(c("gross_amount")), F.lit("0"))), "_sha": F.when(~_type_of(force_type).isin("FV", "PAR", "UMO"), sha),
    })
    nip, day, gross, kind = c("_nip"), c("_day"), c("_gross"), c("document_type")
    low, high = F.least(nip, c("_other")), F.greatest(nip, c("_other"))
    own = lambda name: N.present(c(name))
    join = lambda *x: F.concat_ws("|", *x)
    shown = (
        F.when(kind == "FV", join(nip, F.upper(N.text(c("invoice_number"))), day, gross)).when(kind == "PAR", join(nip, day, gross, own("receipt_number"), own("cash_register_number")))
        .when(kind == "UMO", join(low, high, day, F.upper(own("contract_number")))).otherwise(join(F.left("_sha", F.lit(32)), day, nip))
    )
    hashed = (
        F.when(kind == "FV", join(nip, N.document_number(c("invoice_number")), day, gross)).when(kind == "PAR", join(nip, day, gross, N.code(c("receipt_number")), N.code(c("cash_register_number"))))
        .when(kind == "UMO", join(low, high, day, N.code(c("contract_number")))).otherwise(join(F.left("_sha", F.lit(64)), F.when(own("document_date").isNotNull(), day), F.when(own("issuer_nip").isNotNull(), nip)))
    )
    return df.withColumn("canonical_string", shown).withColumn("document_id", ids.document_id(kind, hashed, prefix)).drop("_nip", "_other", "_day", "_gross", "_sha")


def process(df: DataFrame, force_type: str | None = None, prefix: str = ids.PREFIX) -> DataFrame:
    """Adds what ``extract`` and ``identify`` find to rows with full_text; average_confidence is 1 where there is no such column."""
    if "average_confidence" not in df.columns:
        df = df.withColumn("average_confidence", F.lit(1.0))
    return identify(extract(with_entities(df)), force_type, prefix)


def prior_duplicates(df: DataFrame, order: str = "seq") -> DataFrame:
    """Adds is_duplicate and duplicate_of: the ID that the first row (by ``order``) of this canonical string has, where it is another.

    Canonical strings of one ID alone, nearly all, leave the plan before the join, so that what is joined is small; it has no
    window, which one hot canonical string would keep in a single task. The rows are used twice and their extraction costs most, so they
    are written to the shared folder once, while the plan is made.
    """
    df = written(df, "processed")
    first = df.groupBy(F.col("canonical_string").alias("_canonical")).agg(F.min_by("document_id", order).alias("_first"), (F.min("document_id") != F.max("document_id")).alias("_several"))
    first = first.where("_several").drop("_several")
    out = df.join(first, F.col("canonical_string") == F.col("_canonical"), "left")
    other = F.col("_first") != F.col("document_id")
    return out.withColumn("is_duplicate", F.coalesce(other, F.lit(False))).withColumn("duplicate_of", F.when(other, F.col("_first"))).drop("_canonical", "_first")


def process_batch(df: DataFrame, order: str = "seq", skip_duplicates: bool = True, force_type: str | None = None) -> DataFrame:
    """process and prior_duplicates; duplicates are left out by default. Rows whose ``error`` isn't NULL (rejected files) are left out."""
    if "error" in df.columns:
        df = df.where(F.col("error").isNull()).drop("error")
    out = prior_duplicates(process(df, force_type), order)
    return out.where(~F.col("is_duplicate")) if skip_duplicates else out


def record(df: DataFrame) -> DataFrame:
    """The output row: identity and a struct of the extraction, without net and VAT amounts and kind of contract."""
    told = [f for f in FIELDS if f not in ("net_amount", "vat_amount", "contract_type")]
    out = df.select(
        "document_id", "document_type", "canonical_string", F.col("average_confidence").alias("ocr_confidence"), F.col("source_file") if "source_file" in df.columns else F.lit(None).cast("string").alias("source_file"),
        "is_duplicate", "duplicate_of", F.struct("category", *told).alias("extraction"),
    )
    return out


def verify(df: DataFrame, claimed: str = "claimed_id") -> DataFrame:
    """Adds verified: whether processing gives the claimed ID."""
    return process(df).withColumn("verified", F.coalesce(F.col(claimed) == F.col("document_id"), F.lit(False)))


def determinism(df: DataFrame, times: int = 5) -> DataFrame:
    """Processes each row several times over: key columns seq, n_runs, n_ids, same."""
    again = df.crossJoin(df.sparkSession.range(times).withColumnRenamed("id", "run"))
    return process(again).groupBy("seq").agg(F.count("*").alias("n_runs"), F.countDistinct("document_id").alias("n_ids")).withColumn("same", F.col("n_ids") == 1)
