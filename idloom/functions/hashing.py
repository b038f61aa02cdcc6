"""Hashes and distances of hashes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import strip, text

HASH_BITS = 64
FAR = 999
_HEX = "^[0-9a-fA-F]+$"


def short_sha(c: Column) -> Column:
    """First 16 hex digits of SHA-256, upper case."""
    return F.upper(F.left(F.sha2(c, 256), F.lit(16)))


def veiled_name(c: Column) -> Column:
    """A name that must not be told: 8 hex digits of the MD5 of its upper case. NULL where none is given."""
    return F.when(text(c) != "", F.left(F.md5(F.upper(strip(text(c)))), F.lit(8)))


def content_hash(c: Column) -> Column:
    return F.sha2(text(c), 256)


def _chunk(c: Column, i: int) -> Column:
    """Hex digits i * 8 and on of a hash of 16, as a number; a 64-bit value would overflow."""
    return F.conv(F.substring(c, i * 8 + 1, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two hex hashes; NULL where one is empty or no hex, or their lengths differ."""
    a, b = text(a), text(b)
    fair = (F.length(a) == F.length(b)) & a.rlike(_HEX) & b.rlike(_HEX)
    usual = F.bit_count(_chunk(a, 0).bitwiseXOR(_chunk(b, 0))) + F.bit_count(_chunk(a, 1).bitwiseXOR(_chunk(b, 1)))
    cut = lambda c, i: F.conv(F.substr(c, i, F.lit(8)), 16, 10).cast("long")
    other = F.aggregate(F.sequence(F.lit(1), F.length(a), F.lit(8)), F.lit(0), lambda acc, i: acc + F.bit_count(cut(a, i).bitwiseXOR(cut(b, i))))
    return F.when(fair & (F.length(a) == 16), usual).when(fair, other)


def similarity(a: Column, b: Column) -> Column:
    """1 for equal hashes, 0 for opposite ones; NULL where hamming is."""
    return F.lit(1.0) - hamming(a, b) / (F.length(a) * 4)


def distance_or_far(a: Column, b: Column) -> Column:
    return F.coalesce(hamming(a, b), F.lit(FAR))


def best_distance(dhash_a: Column, phash_a: Column, dhash_b: Column, phash_b: Column) -> Column:
    """The lesser of the distances that can be taken; NULL where neither can."""
    return F.least(hamming(dhash_a, dhash_b), hamming(phash_a, phash_b))


def looks_same(dhash_a: Column, phash_a: Column, dhash_b: Column, phash_b: Column, most: int = 6) -> Column:
    """Whether every distance that can be taken is at most ``most``, and one can."""
    d, p = hamming(dhash_a, dhash_b), hamming(phash_a, phash_b)
    return F.coalesce(F.greatest(d, p) <= most, F.lit(False))


def bits_to_hex(bits: Column) -> Column:
    """Hex of an array of 0 and 1, first bit highest; NULL for an array that isn't of 64."""
    half = lambda at: F.lpad(F.lower(F.hex(F.aggregate(F.slice(bits, at, 32), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b.cast("long")))), 8, "0")
    return F.when(F.size(bits) == HASH_BITS, F.concat(half(1), half(33)))


def as_bits(h: Column) -> Column:
    """A hex hash of 16 digits as one number of 64 bits, with sign; NULL for other texts."""
    return F.when(text(h).rlike("^[0-9a-fA-F]{16}$"), F.shiftleft(_chunk(h, 0), 32).bitwiseOR(_chunk(h, 1)))


def bands(h: Column, most: int, whole: int = 1) -> Column:
    """Keys of a 64-bit hex hash, as (number, bits): hashes that differ in at most ``most`` bits share one.

    The hash is cut into most + whole bands, of which so few flips leave ``whole`` untouched; a key is each combination of that many
    bands. More bands in a key make more keys, of which a random pair shares fewer. NULL for other texts, for which there is no
    distance to a 64-bit hash.
    """
    n = most + whole
    edges = [round(i * HASH_BITS / n) for i in range(n + 1)]
    masks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = [sum(c) for c in combinations(masks, whole)]
    signed = [m - (1 << HASH_BITS) if m >> (HASH_BITS - 1) else m for m in keys]
    number = as_bits(h)
    return F.when(number.isNotNull(), F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m, i: F.struct(i.alias("band"), number.bitwiseAND(m).alias("bits"))))
