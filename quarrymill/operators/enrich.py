"""Enrichment of parsed documents: relative paths, flags, hashes and capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Path fragments of architecture and config documents, and list caps.
ARCHITECTURE_PATHS = ("architecture", "design", "adr", "docs")
CONFIG_PATHS = ("config", "settings", "env", "deployment")
RELATED, COMMENTS, DOCSTRINGS = 25, 50, 25


def relative_path(path: Column, root: str | Column) -> Column:
    """The path below ``root``, or the path itself where it is not below."""
    base = F.lit(root.rstrip("/") + "/") if isinstance(root, str) else F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    below = F.startswith(path, base) & (base != "/")
    return F.when(below, F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


def _has_any(path: Column, names: tuple[str, ...]) -> Column:
    return F.rlike(F.lower(path), F.lit("|".join(names)))


def path_flags(path: Column) -> dict[str, Column]:
    """is_readme by file name; the other two by fragments anywhere in the whole path."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return {
        "is_readme": F.startswith(name, F.lit("readme")),
        "is_architecture_doc": _has_any(path, ARCHITECTURE_PATHS),
        "is_config_doc": _has_any(path, CONFIG_PATHS),
    }


def source_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def related_sections(titles: Column) -> Column:
    return F.slice(F.filter(titles, lambda t: t.isNotNull() & (t != "")), 1, RELATED)


def document_facts(sections: DataFrame, key: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Keys, ``related_sections`` (the first titles) of each document, in the order of its sections."""
    titles = F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "title"))), lambda s: s["title"])
    found = sections.groupBy(*key).agg(titles.alias("_titles"))
    return found.select(*key, related_sections(F.col("_titles")).alias("related_sections"))


def enriched(docs: DataFrame, root: str = "") -> DataFrame:
    """``docs`` (path, text, and lists where parsed) with file_path, source_hash, flags and caps."""
    out = docs.withColumns(
        {"file_path": relative_path(F.col("path"), root) if root else F.col("path"), "source_hash": source_hash(F.col("text")), **path_flags(F.col("path"))}
    )
    for name, most in (("comments", COMMENTS), ("docstrings", DOCSTRINGS)):
        if name in docs.columns:
            out = out.withColumn(name, F.slice(name, 1, most))
    return out
