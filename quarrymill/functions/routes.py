"""Route templates: normal form, match quality and its confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.text import bound, stripped

#: The placeholder, path variables, and segments that are numbers or UUIDs.
PARAM = "{param}"
VARIABLE = r"\{[^}]+\}"
CONCRETE = r"(?<=/)(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|\p{Nd}+)(?=/|$)"
#: Confidence of a link by match quality.
CONFIDENCE = {"exact": 1.0, "template": 0.85, "prefix": 0.6}
OTHER_CONFIDENCE = 0.4


def normalized(path: Column) -> Column:
    """Without query, trailing slashes and concrete ids, with a leading slash; '/' gives ''.

    Not idempotent: a first segment is only seen as an id after the slash was added.
    """
    bare = F.regexp_replace(F.regexp_replace(stripped(path), r"(?d)\?.*$", ""), "/+$", "")
    named = F.regexp_replace(F.regexp_replace(bare, VARIABLE, r"\{param\}"), CONCRETE, r"\{param\}")
    return bound(named, lambda n: F.when((n != "") & ~F.startswith(n, F.lit("/")), F.concat(F.lit("/"), n)).otherwise(n))


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")


def match_quality(front: Column, back: Column) -> Column:
    """exact, prefix, template or none for two routes in normal form; prefix is tested first."""
    a, b = _segments(front), _segments(back)
    alike = F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (x == PARAM) | (y == PARAM)), lambda v: v)
    return (
        F.when(front == back, "exact")
        .when((front != "") & (back != "") & (F.startswith(front, back) | F.startswith(back, front)), "prefix")
        .when((F.size(a) == F.size(b)) & alike, "template")
        .otherwise("none")
    )


def routes_match(front: Column, back: Column) -> Column:
    """Match quality of two raw routes."""
    return match_quality(normalized(front), normalized(back))


def confidence(quality: Column) -> Column:
    out = F.lit(OTHER_CONFIDENCE)
    for name, value in CONFIDENCE.items():
        out = F.when(quality == name, value).otherwise(out)
    return out
