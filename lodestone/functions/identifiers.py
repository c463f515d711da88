"""Deterministic identifiers from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_number(digits: Column) -> Column:
    """The number that up to fifteen hexadecimal digits stand for."""
    return F.conv(digits, 16, 10).cast("long")


def point_id(*parts: Column) -> Column:
    """Sixty bits of the SHA-256 of the parts joined by bars, modulo 10**15."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return hex_number(F.substring(F.sha2(joined.cast("binary"), 256), 1, 15)) % F.lit(10**15)


def uuid_of(text: Column) -> Column:
    """A UUID-shaped id from the SHA-1 of a text."""
    h = F.sha1(text.cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def term_id(term: Column) -> Column:
    """Thirty-one bits of a term: the first four MD5 bytes, little-endian."""
    h = F.md5(term.cast("binary"))
    turned = F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    return hex_number(turned).bitwiseAND(0x7FFFFFFF)


def citation_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat(*[p.cast("string") for p in parts]).cast("binary")), 1, 12)


def gate(key: Column, modulus: int) -> Column:
    """Hash gate of a key: the first eight SHA-256 digits modulo ``modulus``."""
    return hex_number(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 8)) % modulus


def shuffle_key(seed: int, *key: Column) -> Column:
    """What "random order" means here: reproducible order by SHA-256 of seed and key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"), 256)
