"""Text functions as column expressions, with the results that Python's ``re`` and ``str`` give.

Patterns use explicit Unicode classes and ``(?d)`` line ends because Java's defaults differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of word characters or single other marks; terms of the keyword index.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
TERM = r"[a-z0-9_]+"
#: White space: what the classes s and Z of patterns stand for.
SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of one group; an optional group that did not take part gives ''."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; what lies between is not looked at by a pattern."""
    return F.btrim(text, F.lit(SPACES))


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(TOKEN)))


def terms(text: Column) -> Column:
    return matches(F.lower(text), TERM)


def columns(key: str | Sequence[str]) -> list[str]:
    """The names of a key of one column or several."""
    return [key] if isinstance(key, str) else list(key)


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def non_empty(values: Column) -> Column:
    """Distinct values in first-seen order, without empty ones."""
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def uuid5(name: Column) -> Column:
    """Name-based UUID (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)), 2, "0"))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 19, 2)),
        F.substring(h, 21, 12),
    )


def digest_bucket(digest: Column, dim: int) -> Column:
    """An MD5, as a number, modulo ``dim``: Horner's rule over its 32-bit pieces that matter."""
    out = F.lit(0).cast("long")
    for k in range(3 if (1 << 32) % dim == 0 else 0, 4):
        piece = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        out = F.pmod(out * ((1 << 32) % dim) + piece, F.lit(dim).cast("long"))
    return out.cast("int")


def digest_sign(digest: Column) -> Column:
    """1 or -1 by bit 8 of an MD5 as a number."""
    digit = F.conv(F.substring(digest, 30, 1), 16, 10).cast("int")
    return F.when(digit.bitwiseAND(1) == 1, 1.0).otherwise(-1.0)


def hash_bucket(term: Column, dim: int) -> Column:
    return digest_bucket(F.md5(term), dim)


def hash_sign(term: Column) -> Column:
    return digest_sign(F.md5(term))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
