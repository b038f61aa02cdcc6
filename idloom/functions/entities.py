"""Entities in texts: tax numbers, amounts, dates, document numbers, payment traces.

A finder gives an array without repeats: all hits of its first pattern in the order of the text, then those of the second, and so
on. Callers rely on which hit comes first. NULL texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import digits_valid, once, some, text

SEP = r"[-./]"
#: Flags: any case, also beyond ASCII; with U, blanks and letters beyond ASCII too.
ANY, ANY_U = "(?iu)", "(?iU)"
NUMBER = r"(\d[\d\s,.]*\d)"
TOKEN = r"([A-Z0-9/\-]+)"
NUMBERED = r"([A-Z0-9/\-]*\d+[A-Z0-9/\-]*)"
GAP = r"[:\s]*"
MONEY = r"(\d{1,3}(?:\s?\d{3})*[,.]\d\d)"


def tag(name: str) -> str:
    return f"<{name}>([^<]+)</{name}>"


def day(*widths: int) -> str:
    return SEP.join(rf"\d{{{w}}}" for w in widths)


#: Ten digits in a row after the word are hits of the first pattern too.
TAX_NUMBERS = [ANY_U + "NIP" + GAP + "(" + "".join(rf"\d{{{n}}}" + (r"[-\s]?" if i < 3 else "") for i, n in enumerate((3, 3, 2, 2))) + ")", "(" + "-".join(rf"\d{{{n}}}" for n in (3, 3, 2, 2)) + ")", r"(?<!\d)(\d{10})(?!\d)"]
AMOUNT_TAGS = ["TotalGrossAmount", "TotalNetAmount", "TotalVATAmount", "GrossAmount", "NetAmount", "VATAmount", "UnitPrice"]
AMOUNTS = [ANY_U + MONEY, ANY_U + "(?:" + "|".join(["do zapłaty", "suma", "razem", "netto", "brutto"]) + ")" + GAP + MONEY, ANY_U + r"(\d+[,.]\d\d)\s*(?:PLN|zł)", *[ANY + tag(t) for t in AMOUNT_TAGS]]
DATE_TAGS = ["IssueDate", "issue_date", "DataWystawienia", "DataWystaw"]
DATES = [*map(tag, DATE_TAGS), *[rf"\b({day(*w)})\b" for w in ((2, 2, 4), (4, 2, 2), (2, 2, 2))]]
_J = r"[\s/\-]?"
NUMBER_TAGS = ["InvoiceNumber", "invoice_number", "FakturaNumer", "ReceiptNumber", "receipt_number"]
DOCUMENT_NUMBERS = [
    ANY_U + "(?:" + "|".join(["faktura", "fv", "rachunek", "nr"]) + ")" + GAP + r"([A-Z0-9/\-]+\d+[A-Z0-9/\-]*)",
    ANY_U + "(?:numer|nr)" + GAP + "(" + _J.join(["[A-Z]{1,3}", *[rf"\d{{{n}}}" for n in ("1,4", "2,4", "2,6")]]) + ")",
    ANY_U + "(FV" + _J + r"\d+" + (_J + r"\d*") * 2 + ")",
    ANY_U + "(F" + _J + r"\d+" + _J + r"\d{4})",
    *[ANY + tag(t) for t in NUMBER_TAGS],
]


def _where_tags(t: Column, pattern: str, hits: Column) -> Column:
    """Hits of a pattern with closing tags, which is tried where a text has one alone."""
    return F.when(F.contains(text(t), F.lit("</")), hits) if "</" in pattern else hits


def _hits(t: Column, patterns: list[str]) -> Column:
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.coalesce(_where_tags(t, p, F.regexp_extract_all(text(t), F.lit(p), F.lit(1))), none) for p in patterns]))


def find_all(t: Column, patterns: list[str], clean: Callable[[Column], Column] = lambda x: x, keep: Callable[[Column], Column] | None = None) -> Column:
    out = F.transform(_hits(t, patterns), clean)
    return F.array_distinct(F.filter(out, keep) if keep else out)


def first_match(t: Column, *patterns: str, group: int = 1) -> Column:
    """What the first of the patterns that matches captures; NULL where none does."""
    return F.coalesce(*[_where_tags(t, p, some(F.regexp_extract(text(t), p, group))) for p in patterns])


def tax_numbers(t: Column) -> Column:
    return find_all(t, TAX_NUMBERS, lambda m: F.regexp_replace(m, r"(?U)[\s\-]", ""), digits_valid)


def amounts(t: Column) -> Column:
    return find_all(t, AMOUNTS, lambda m: F.translate(F.translate(m, " \u00a0", ""), ",", "."))


def dates(t: Column) -> Column:
    """Dates; those of a well-known XML namespace aside."""
    return F.array_distinct(F.concat(_hits(t, DATES[:4]), F.filter(_hits(t, DATES[4:]), lambda d: ~d.startswith("2023/06/29"))))


def document_numbers(t: Column) -> Column:
    return find_all(t, DOCUMENT_NUMBERS, lambda m: F.upper(F.regexp_replace(m, r"(?U)^\s+|\s+$", "")), lambda m: F.length(m) >= 4)


def entities(t: Column) -> Column:
    """A struct of the four."""
    return F.struct(tax_numbers(t).alias("nips"), amounts(t).alias("amounts"), dates(t).alias("dates"), document_numbers(t).alias("invoice_numbers"))


def money_tokens(t: Column) -> Column:
    """Amounts with two decimals, as a set."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(t), F.lit(r"(\d{1,4}[.,]\d\d)"), F.lit(1)), lambda m: F.translate(m, ",", ".")))


def money_overlap(a: Column, b: Column) -> Column:
    """shared and jaccard of two sets of money tokens; 0 where one is empty."""
    n, u = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.struct(F.when(some, n).otherwise(0).alias("shared"), F.when(some, n.cast("double") / F.greatest(u, F.lit(1))).otherwise(F.lit(0.0)).alias("jaccard"))


_FAR = lambda n: rf"\b[^0-9]{{0,{n}}}"
TRACE_NUMBER = ["(?:" + "|".join(["faktura", "paragon", "rachunek"]) + r")\s*nr" + _FAR(6) + "([0-9]{3,})", r"\bnr" + _FAR(4) + "([0-9]{4,})"]
TRACE_AUTH = ["(?:" + "|".join(["autoryzacji", "ryzacji", r"authoriz\w*", r"\bcji"]) + ")" + _FAR(6) + "([0-9]{4,})", r"([0-9]{5,7})\s*\(\s*1\s*\)"]
TRACE_CARD = r"\b(\d{4})\b\s*wa\w?zna\s*do"
CLOCK = r"\b([0-2]?\d):([0-5]\d)"
ISO_DAY = rf"\b(20\d\d){SEP}(\d\d){SEP}(\d\d)\b"
LOCAL_DAY = rf"\b(\d\d){SEP}(\d\d){SEP}(20\d\d)\b"


def payment_trace(t: Column) -> Column:
    """What tells a payment apart: number, auth, time (HHmmss), card, '' where missing; datetime is NULL without both day and time."""
    low = F.lower(text(t))
    or_none = lambda c: F.coalesce(c, F.lit(""))
    two = lambda c: F.lpad(c, 2, "0")
    # a text is searched once for each pattern; groups are those of the hit, which the pattern matches whole
    hit = lambda p: some(F.regexp_extract(text(t), p, 0))
    at = lambda m, p, *groups: [some(F.regexp_extract(m, p, g)) for g in groups]
    to_second, to_minute = CLOCK + r":([0-5]\d)\b", CLOCK + r"(?::([0-5]\d))?\b"

    def exact(m: Column) -> Column:
        h, mm, s = at(m, to_second, 1, 2, 3)
        return F.concat(two(h), mm, s)

    def rough(m: Column) -> Column:
        h, mm, s = at(m, to_minute, 1, 2, 3)
        return F.concat(two(h), mm, or_none(s))

    time = once(hit(to_second), exact)
    iso = once(hit(ISO_DAY), lambda m: F.concat(F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2)))
    local = once(hit(LOCAL_DAY), lambda m: F.concat(F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    stamp = F.concat(F.coalesce(iso, local), once(hit(to_minute), rough))
    return F.struct(
        or_none(first_match(low, *TRACE_NUMBER)).alias("number"), or_none(first_match(low, *TRACE_AUTH)).alias("auth"),
        or_none(time).alias("time"), or_none(first_match(low, TRACE_CARD)).alias("card"), stamp.alias("datetime"),
    )
