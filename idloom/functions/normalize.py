"""Normalisers of business values: Column in, Column out.

A NULL is an empty value everywhere, and results are never NULL unless said otherwise. Malformed input gives a defined result
and never an error, under ANSI mode too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)\s+"
#: Control digits of a tax number: weights of its first nine digits.
TAX_WEIGHTS = tuple(map(int, "657234567"))
#: Values of a field that say nothing, for fusing records.
EMPTY_VALUES = ("-", "kwota-nieznana", "n/a", "nieznana", "unknown")
#: Values that say nothing, for completeness and business keys.
UNKNOWN_VALUES = ("", "ina-gruba", "kontrahent-nieznany", "kwota-nieznana", "nieznana", "unknown")


def text(c: Column) -> Column:
    """The value as a string; '' where NULL."""
    return F.coalesce(c.cast("string"), F.lit(""))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once. In the branches of a condition Spark computes a value anew for each use."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def some(c: Column) -> Column:
    """NULL where a computed text is ''."""
    return once(c, lambda x: F.when(x != "", x))


def present(c: Column) -> Column:
    """NULL where the value is '' or NULL: the tail that concat_ws leaves out."""
    return F.nullif(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without blanks, Unicode ones too, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tax_number(c: Column) -> Column:
    """Upper case, without a leading country code, blanks, dashes and dots. Nothing is validated."""
    return F.regexp_replace(F.regexp_replace(F.upper(text(c)), "^[A-Z]{2}", ""), r"(?U)[\s\-.]", "")


def _control_digit_fits(n: Column) -> Column:
    digit = lambda i: F.ascii(F.substring(n, i, 1)) - 48
    total = sum((digit(i) * w for i, w in enumerate(TAX_WEIGHTS, 1)), F.lit(0))
    return F.pmod(total, F.lit(11)) == digit(10)


def is_tax_number(c: Column) -> Column:
    """Whether ten digits with a right control digit are left after normalising. A remainder of 10 never is right."""
    return digits_valid(tax_number(c))


def digits_valid(n: Column) -> Column:
    """The control of a value that is normalised already."""
    return n.rlike("^[0-9]{10}$") & _control_digit_fits(n)


def amount(c: Column) -> Column:
    """A number with two decimals, half up, as a string; '0.00' where it can't be read or needs over 28 digits.

    Blanks and the letters of the currency's names are left out, a comma is a point, and of several points the last is the decimal
    one. Numbers go by way of their shortest decimal form, so that a double rounds as it prints.
    """
    s = F.translate(F.regexp_replace(F.upper(text(c)), r"(?U)[LNPZŁ\s]", ""), ",", ".")
    d = F.regexp_replace(s, r"\.(?=.*\.)", "").try_cast("decimal(38,2)")
    return once(d, lambda d: F.when(F.abs(d) < F.lit("1e26").cast("decimal(38,2)"), d.cast("string")).otherwise(F.lit("0.00")))


#: Shapes of dates, and how their year, month and day stand in them; a date that is none is no error.
_SHAPES = [(r"^(\d{1,2})(-|\.|/| )(\d{1,2})\2(\d{4})$", "$4-$3-$1"), (r"^(\d{4})(-|/)(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"), (r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")]
_LOOSE = [(r"(?s)^\D*(\d{4})\D+(\d+)\D+(\d+).*$", "$1-\x01$2-\x01$3"), (r"(?s)^\D*((?!\d{4}\D)\d+)\D+(\d+)\D+(\d{4})(?!\d).*$", "$3-\x01$2-\x01$1"), ("\x01(?=\\d\\d)", ""), ("\x01", "0")]


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd of a date written year first with - or /, or day first with - . / or blanks, or as eight digits.

    Else, of the first three runs of digits: with four digits first as they stand, with four digits third the other way round, unchecked. Else
    the text without outer blanks. Dates and timestamps may come as such.
    """
    def read(s: Column) -> Column:
        shaped, loose = F.regexp_replace(s, BLANKS, " "), s
        for pattern, order in _SHAPES:
            shaped = F.regexp_replace(shaped, pattern, order)
        for pattern, order in _LOOSE:
            loose = F.regexp_replace(loose, pattern, order)
        return F.coalesce(F.try_to_date(shaped, "yyyy-M-d").cast("string"), loose)

    return once(strip(text(c)), read)


def document_number(c: Column) -> Column:
    """Upper case; runs of blanks, dashes, underlines and slashes are one slash, none at the ends."""
    s = F.regexp_replace(strip(F.upper(text(c))), r"(?U)[\s\-_]+", "/")
    return F.regexp_replace(F.regexp_replace(s, "/+", "/"), "^/|/$", "")


def code(c: Column) -> Column:
    """Upper case without outer blanks; NULL where nothing is left or given: an optional part of an identity."""
    return F.when(present(c).isNotNull(), F.upper(strip(text(c))))


def account_number(c: Column) -> Column:
    return F.regexp_replace(text(c), r"(?U)[\s\-]", "")


def printed_amount(c: Column) -> Column:
    """An amount as found in a text, with two decimals; '' where it can't be read. The sign is lost.

    Points before the last are dropped only where two digits follow the last.
    """
    s = F.translate(F.regexp_replace(text(c), r"[^\d,.]", ""), ",", ".")
    d = once(s, lambda s: F.when(s.rlike(r"\.\d\d$"), F.regexp_replace(s, r"\.(?=.*\.)", "")).otherwise(s).try_cast("double"))
    return once(d, lambda d: F.when(d.isNotNull(), F.format_string("%.2f", d)).otherwise(F.lit("")))


def printed_date(c: Column) -> Column:
    """yyyy-MM-dd of the first date in a text, looked for as Y-M-D, then D-M-Y, then D-M-y in this century; else the text."""
    def read(s: Column) -> Column:
        tries = []
        for a, b, order in ((4, 2, "$1-$2-$3"), (2, 4, "$3-$2-$1"), (2, 2, "20$3-$2-$1")):
            p = rf"\b(\d{{{a}}})[-/.](\d\d)[-/.](\d{{{b}}})\b"
            tries.append(F.regexp_replace(some(F.regexp_extract(s, p, 0)), p, order))
        return F.coalesce(*tries, s)

    return once(text(c), read)


#: Letters that lose their mark when decomposed, and ligatures; a letter that has no decomposition is dropped.
_MARKED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿĄąĆćČčĎďĘęĚěŃńŇňŘřŚśŠšŤťŮůŰűŹźŻżŽžŐőÅåĀāĒēĪīŌōŪūĂăȘșȚțŢţĞğİ"
_PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyyAaCcCcDdEeEeNnNnRrSsSsTtUuUuZzZzZzOoAaAaEeIiOoUuAaSsTtTtGgI"


def plain_text(c: Column) -> Column:
    """Lower-case ASCII: letters lose their marks, other characters than letters, digits and . , : / @ + - become a blank, blanks are one.

    A letter without decomposition (ł, ß) is dropped. Letters are those of Latin-1, Latin-2 and the common ligatures; marks
    that stand by themselves are dropped, as is all else beyond ASCII.
    """
    s = F.replace(F.replace(F.translate(text(c), _MARKED, _PLAIN), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    s = F.regexp_replace(F.regexp_replace(s, "[  -  　]", " "), r"[^\x00-\x7f]", "")
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9.,:/@+-]+", " "))


def is_empty(c: Column) -> Column:
    """Whether a field says nothing: NULL, blank or one of EMPTY_VALUES."""
    return F.lower(strip(text(c))).isin("", *EMPTY_VALUES)


def is_unknown(c: Column) -> Column:
    return F.lower(strip(text(c))).isin(*UNKNOWN_VALUES)


def field(top: Column, nested: Column) -> Column:
    """Of a record with a field at its top and in its metadata: the top one unless blank, lower case, without outer blanks."""
    return F.lower(strip(F.coalesce(F.when(strip(text(top)) != "", text(top)), text(nested))))


def upper_strip(c: Column) -> Column:
    """Upper case without outer blanks; '' where NULL: a mandatory part of an identity."""
    return F.upper(strip(text(c)))
