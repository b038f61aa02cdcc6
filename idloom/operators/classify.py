"""What kind of document a text is, and its business fields.

Input rows have ``full_text``, ``average_confidence`` and the entity arrays ``nips``, ``amounts``, ``dates``, ``invoice_numbers``
(``with_entities`` adds those). Extractors are pairs of a score and of fields, both Columns; ``EXTRACTORS`` may be extended. A
value that isn't found is NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions import normalize as N

INVOICE_WORDS = sorted("brutto netto vat nip podatek invoice rachunek fv faktura nabywca sprzedawca".split())
RECEIPT_WORDS = sorted("suma ptu reszta karta gotówka sprzedaż kasa fiskalny paragon".split())
CONTRACT_WORDS = sorted("termin wynagrodzenie przedmiot zleceniodawca zamawiający wykonawca strona zlecenie porozumienie kontrakt umowa".split())
CONTRACT_KINDS = [("zlecenie", "ZLECENIE"), ("o dzieło", "DZIELO"), ("najmu", "NAJEM"), ("sprzedaży", "SPRZEDAZ"), ("współpracy", "WSPOLPRACA"), ("o pracę", "PRACA")]
ELIGIBLE = 0.4
FIELDS = ("document_date", "issuer_nip", "buyer_nip", "invoice_number", "gross_amount", "net_amount", "vat_amount", "receipt_number", "cash_register_number", "party2_nip", "contract_number", "contract_type")
TYPE_OF = {"invoice": "FV", "receipt": "PAR", "contract": "UMO", "bank_statement": "WB"}

A = E.ANY_U


@dataclass(frozen=True)
class Extractor:
    """One kind of document: a score in 0..1 and fields by name."""

    category: str
    score: Callable[[], Column]
    fields: Callable[[], dict[str, Column]]


def with_entities(df: DataFrame, text: str = "full_text") -> DataFrame:
    found = E.entities(F.col(text))
    return df.withColumn("_entities", found).select(*[F.col(f"`{c}`") for c in df.columns if c not in ("nips", "amounts", "dates", "invoice_numbers")], "_entities.*")


def _text() -> Column:
    return F.col("full_text")


def _words(words: list[str]) -> Column:
    low = F.lower(N.text(_text()))
    return sum((low.contains(w).cast("int") for w in words), F.lit(0)).cast("double")


def _part(when: Column, weight: float) -> Column:
    return F.when(when, F.lit(weight)).otherwise(F.lit(0.0))


def _total(first: Column, *parts: Column) -> Column:
    # added from the left, as thresholds are strict and sums of doubles depend on the order
    for p in parts:
        first = first + p
    return F.least(F.lit(1.0), first)


def invoice_score() -> Column:
    some = lambda c: F.size(c) > 0
    return _total(_words(INVOICE_WORDS) * F.lit(0.15), _part(some("nips"), 0.2), _part(some("amounts"), 0.2), _part(some("invoice_numbers"), 0.2))


def receipt_score() -> Column:
    low = F.lower(N.text(_text()))
    return _total(
        _words(RECEIPT_WORDS) * F.lit(0.15), _part(low.contains("fiskaln") | low.contains("paragon"), 0.3), _part(low.contains("ptu") | low.rlike(r"\d+%"), 0.2),
        _part(low.rlike("(?s)<receipt[^>]*>.*?</receipt>"), 0.4), _part(low.rlike("<fiscal|<cashregister|<receiptnumber"), 0.3),
    )


def contract_score() -> Column:
    low = F.lower(N.text(_text()))
    return _total(_words(CONTRACT_WORDS) * F.lit(0.1), _part(low.contains("umowa") | low.contains("kontrakt"), 0.3), _part(low.contains("strona") | low.contains("wykonawca"), 0.2))


_HEAD = lambda labels, tail: A + r"\b(?:" + "|".join(labels) + r")\b\s*" + tail + r"[:\s]+" + E.NUMBERED
INVOICE_NUMBER = [_HEAD(["dokumentu", "rachunek", "fv", "faktura"], r"(?:vat)?\s*(?:nr|numer)?"), _HEAD(["numer", "nr"], "(?:dokumentu|fv|faktury)?"), *map(E.tag, E.NUMBER_TAGS[:3])]
_ANY_DAY = "(" + E.SEP.join([r"\d{2,4}", r"\d\d", r"\d{2,4}"]) + ")"
ISSUE_DATE = [A + label + E.GAP + _ANY_DAY for label in (r"data\s*wystawienia", r"wystawion[ao]\s*(?:dnia)?", "data")] + [E.tag(t) for t in E.DATE_TAGS]
_SUM = r"suma" + "".join(rf"(?!\s+{x})" for x in ("ptu", "vat"))
RECEIPT_TOTAL = [A + _SUM + E.GAP + E.NUMBER, *[A + x + E.GAP + E.NUMBER for x in ("razem", "do zapłaty")], A + E.tag("TotalGrossAmount"), A + r"<span>suma:</span>\s*<span>" + E.NUMBER + "</span>", A + _SUM + "[^0-9]*?" + E.NUMBER]
PAYMENTS = [(A + x + E.GAP, "") for x in ("płatność", "karta", "gotówka")] + [(A + r"<span>gotówka:</span>\s*<span>", "</span>")]
CONTRACT_DATE = [A + x + E.GAP + f"({E.day(2, 2, 4)})" for x in (r"zawarta\s*(?:w\s*dniu)?", "dnia", "data")]
CONTRACT_NUMBER = [A + a + r"\s*(?:" + b + ")?" + E.GAP + E.TOKEN for a, b in (("umowa", "numer|nr"), ("(?:numer|nr)", "umowy"))]


def _first(array: str, i: int = 0) -> Column:
    return F.get(F.col(array), F.lit(i))


def _largest(amounts: Column) -> Column:
    values = F.transform(amounts, lambda a: F.coalesce(N.printed_amount(a).try_cast("double"), F.lit(0.0)))
    return F.format_string("%.2f", F.array_max(values))


def _date_or_detected(found: Column) -> Column:
    return N.once(F.coalesce(found, _first("dates")), lambda d: F.when(d.isNotNull(), N.printed_date(d)))


def invoice_fields() -> dict[str, Column]:
    t = _text()
    label = lambda words, name: N.some(N.printed_amount(F.coalesce(E.first_match(t, E.tag(name)), E.first_match(t, A + words + E.GAP + E.NUMBER))))
    return {
        "document_date": _date_or_detected(E.first_match(t, *ISSUE_DATE)), "issuer_nip": _first("nips"), "buyer_nip": _first("nips", 1),
        "invoice_number": F.coalesce(F.upper(N.strip(E.first_match(t, *INVOICE_NUMBER))), _first("invoice_numbers")),
        "gross_amount": F.coalesce(label("brutto", "TotalGrossAmount"), F.when(F.size("amounts") > 0, _largest(F.col("amounts")))),
        "net_amount": label("netto", "TotalNetAmount"), "vat_amount": label("(?:podatek|vat)", "TotalVATAmount"),
    }


def receipt_fields() -> dict[str, Column]:
    t = _text()
    total = E.first_match(t, *RECEIPT_TOTAL)
    # an amount is looked for as a pattern: its point stands for any character
    shape = lambda a: F.regexp_replace(a, r"[^0-9A-Za-z.]", r"\\$0")
    paid = lambda a: F.array_contains(F.array(*[F.regexp_like(t, F.concat(F.lit(x), shape(a), F.lit(y))) for x, y in PAYMENTS]), True)
    unpaid = F.filter("amounts", lambda a: ~paid(a))
    number = F.coalesce(E.first_match(t, A + r"(?:numer|nr)\s*(?:paragonu)?" + E.GAP + E.TOKEN), E.first_match(t, E.tag("ReceiptNumber")))
    register = F.coalesce(E.first_match(t, A + "(?:stanowisko|kasa)" + E.GAP + r"(\d+)"), E.first_match(t, E.tag("CashRegisterNumber")))
    return {
        "document_date": F.when(_first("dates").isNotNull(), N.printed_date(_first("dates"))), "issuer_nip": _first("nips"),
        "gross_amount": N.once(total, lambda x: F.when(x.isNotNull(), N.some(N.printed_amount(x))).otherwise(N.once(unpaid, lambda u: F.when(F.size(u) > 0, _largest(u))))),
        "receipt_number": number, "cash_register_number": N.once(register, lambda x: N.once(number, lambda n: F.when(n.isNull() | ~F.contains(n, x), x))),
    }


def contract_fields() -> dict[str, Column]:
    t = _text()
    low = F.lower(N.text(t))
    kind = F.lit(None).cast("string")
    for word, name in reversed(CONTRACT_KINDS):
        kind = F.when(low.contains(word), name).otherwise(kind)
    return {
        "document_date": _date_or_detected(E.first_match(t, *CONTRACT_DATE)), "issuer_nip": _first("nips"), "party2_nip": _first("nips", 1),
        "contract_number": F.upper(E.first_match(t, *CONTRACT_NUMBER)), "contract_type": kind,
    }


def unknown_fields() -> dict[str, Column]:
    return {"document_date": _first("dates"), "issuer_nip": _first("nips")}


#: In order: of equal scores the earlier wins.
EXTRACTORS = [Extractor("invoice", invoice_score, invoice_fields), Extractor("receipt", receipt_score, receipt_fields), Extractor("contract", contract_score, contract_fields)]


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS])


def classify(df: DataFrame, extractors: list[Extractor] | None = None) -> DataFrame:
    """Adds scores (a struct by category) and category: the best score over ELIGIBLE, the earlier of equal ones, else unknown."""
    known = extractors or EXTRACTORS
    df = df.withColumn("scores", F.struct(*[x.score().alias(x.category) for x in known]))
    ranked = F.array_max(F.filter(F.array(*[F.struct(F.col(f"scores.{x.category}").alias("s"), F.lit(-i).alias("o"), F.lit(x.category).alias("c")) for i, x in enumerate(known)]), lambda x: x["s"] > ELIGIBLE))
    return df.withColumn("category", F.coalesce(ranked["c"], F.lit("unknown")))


def extract(df: DataFrame, extractors: list[Extractor] | None = None) -> DataFrame:
    """Adds category, confidence (that of the text's recognition) and the FIELDS of the best extractor."""
    known = extractors or EXTRACTORS
    df = classify(df, known)
    pick = _struct(unknown_fields())
    for x in reversed(known):
        pick = F.when(F.col("category") == x.category, _struct(x.fields())).otherwise(pick)
    df = df.withColumn("confidence", F.col("average_confidence")).withColumn("_fields", pick)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("_fields", "scores", *FIELDS)], "_fields.*")


def extract_all(df: DataFrame, key: list[str], extractors: list[Extractor] | None = None) -> DataFrame:
    """A row for each eligible extractor: key columns, rank (0 first), category, confidence (its score), FIELDS; best first, then in order."""
    known = extractors or EXTRACTORS
    df = classify(df, known)
    each = F.array(*[F.when(F.col(f"scores.{x.category}") > ELIGIBLE, F.struct((-F.col(f"scores.{x.category}")).alias("o"), F.lit(i).alias("i"), F.lit(x.category).alias("category"), _struct(x.fields()).alias("f"))) for i, x in enumerate(known)])
    df = df.select(*key, F.posexplode(F.array_sort(F.filter(each, lambda x: x.isNotNull()))).alias("rank", "x"))
    return df.select(*key, "rank", F.col("x.category").alias("category"), (-F.col("x.o")).alias("confidence"), "x.f.*")
