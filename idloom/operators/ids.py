"""Identities of business documents: normalised fields, joined by '|', hashed with SHA-256.

``PREFIX-TYPE-HASH``: the type isn't hashed, so a bill and an invoice of equal fields share the hash. Mandatory parts stay as '' where
missing, optional ones are left out. ``canonical`` is the joined string; ``document_id`` makes the ID of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.hashing import short_sha, veiled_name

PREFIX = "DOC"
#: Business types by code.
TYPES = dict(FV="INVOICE", PAR="RECEIPT", UMO="CONTRACT", WB="BANK_STATEMENT", KOR="CORRECTION", PRO="PROFORMA", ZAL="ADVANCE", RAC="BILL", KP="CASH_IN", KW="CASH_OUT", NK="DEBIT_NOTE", WZ="DELIVERY_NOTE", PZ="GOODS_RECEIPT", DEL="EXPENSE_REPORT", DOC="OTHER")


def _joined(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def _maybe(c: Column | None, rule) -> list[Column]:  # noqa: ANN001
    """An optional part: none where the caller has no column, NULL where the row has no value."""
    return [] if c is None else [F.when(N.present(c).isNotNull(), rule(c))]


def document_id(kind: str | Column, canonical: Column, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit(prefix + "-"), F.lit(kind) if isinstance(kind, str) else kind, F.lit("-"), short_sha(canonical))


def invoice(seller_nip: Column, number: Column, issued: Column, gross: Column) -> Column:
    return _joined(N.tax_number(seller_nip), N.document_number(number), N.iso_date(issued), N.amount(gross))


bill = invoice


def receipt(seller_nip: Column, day: Column, gross: Column, number: Column | None = None, register: Column | None = None) -> Column:
    return _joined(N.tax_number(seller_nip), N.iso_date(day), N.amount(gross), *_maybe(number, N.code), *_maybe(register, N.code))


def contract(party1_nip: Column, party2_nip: Column, day: Column, number: Column | None = None, kind: Column | None = None) -> Column:
    """The parties in either order give one identity."""
    a, b = N.tax_number(party1_nip), N.tax_number(party2_nip)
    return _joined(F.least(a, b), F.greatest(a, b), N.iso_date(day), *_maybe(number, N.code), *_maybe(kind, N.code))


def bank_statement(account: Column, day: Column, number: Column | None = None) -> Column:
    return _joined(N.account_number(account), N.iso_date(day), *_maybe(number, lambda c: N.strip(N.text(c))))


def correction(seller_nip: Column, number: Column, issued: Column, corrected_number: Column, gross: Column) -> Column:
    return _joined(N.tax_number(seller_nip), N.document_number(number), N.iso_date(issued), N.document_number(corrected_number), N.amount(gross))


def cash(number: Column, day: Column, amount: Column, issuer_nip: Column | None = None, name: Column | None = None) -> Column:
    """Cash in and cash out; the name is veiled."""
    return _joined(N.upper_strip(number), N.iso_date(day), N.amount(amount), *_maybe(issuer_nip, N.tax_number), *_maybe(name, veiled_name))


def debit_note(issuer_nip: Column, number: Column, issued: Column, amount: Column, recipient_nip: Column | None = None) -> Column:
    return _joined(N.tax_number(issuer_nip), N.upper_strip(number), N.iso_date(issued), N.amount(amount), *_maybe(recipient_nip, N.tax_number))


def delivery_note(issuer_nip: Column, number: Column, issued: Column, recipient_nip: Column | None = None) -> Column:
    return _joined(N.tax_number(issuer_nip), N.upper_strip(number), N.iso_date(issued), *_maybe(recipient_nip, N.tax_number))


def expense_report(employee: Column, day: Column, amount: Column, number: Column | None = None, company_nip: Column | None = None) -> Column:
    return _joined(N.upper_strip(employee), N.iso_date(day), N.amount(amount), *_maybe(number, N.code), *_maybe(company_nip, N.tax_number))


def generic(content_hash: Column, day: Column | None = None, issuer_nip: Column | None = None) -> Column:
    return _joined(F.left(N.text(content_hash), F.lit(64)), *_maybe(day, N.iso_date), *_maybe(issuer_nip, N.tax_number))


def verify(identity: Column, canonical: Column) -> Column:
    """Whether an ID has three parts and the hash of the canonical string; its prefix and type don't count."""
    parts = F.split(N.text(identity), "-")
    return (F.size(parts) == 3) & (F.coalesce(F.get(parts, F.lit(2)), F.lit("")) == short_sha(N.text(canonical)))


def parse(identity: Column) -> Column:
    """prefix, type_code, hash, document_type (NULL for a code that isn't known); a NULL struct where there aren't three parts."""
    parts = F.split(identity, "-")
    part = lambda i: F.get(parts, F.lit(i))
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.when(F.size(parts) == 3, F.struct(part(0).alias("prefix"), part(1).alias("type_code"), part(2).alias("hash"), F.try_element_at(names, part(1)).alias("document_type")))


def local_fallback(pipeline_id: Column, ocr_text: Column, content: Column | None = None, normalized: Column | None = None) -> Column:
    """id, provider, source: the pipeline's ID, else one of the plain text of 24 characters or more, else of the file's bytes (or text)."""
    given = N.present(pipeline_id)

    def read(plain: Column) -> Column:
        bytes_ = plain.cast("binary") if content is None else F.coalesce(content.cast("binary"), plain.cast("binary"))
        long_enough = F.length(plain) >= 24
        own = F.concat(F.lit("LOCAL-DOC-"), F.when(long_enough, short_sha(plain)).otherwise(short_sha(bytes_)))
        return F.struct(
            F.coalesce(given, own).alias("id"), F.when(given.isNotNull(), "pipeline").otherwise("local-fallback").alias("provider"),
            F.when(given.isNotNull(), "identity").when(long_enough, "ocr-text").otherwise("file-sha256").alias("source"),
        )

    return N.once(N.plain_text(ocr_text) if normalized is None else N.text(normalized), read)


def with_id(df: DataFrame, kind: str, canonical: Column, prefix: str = PREFIX) -> DataFrame:
    """Adds canonical_string and document_id."""
    return df.withColumn("canonical_string", canonical).withColumn("document_id", document_id(kind, F.col("canonical_string"), prefix))
