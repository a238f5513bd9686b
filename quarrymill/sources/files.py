"""Repositories of files as a table, by Spark's binary file reader."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.code import SOURCE_SUFFIXES
from quarrymill.operators.documents import PDF_SUFFIXES, suffix

#: Folders left out, and suffixes of documents.
SKIPPED = (".git", "node_modules", ".venv", "venv", "dist", "build", "target", "__pycache__")
DOCUMENT_SUFFIXES = (".md", ".mdx", ".rst", ".txt", ".html", ".htm", ".pdf")


def supported(path):
    """Whether a path has a supported suffix and no part that is a skipped folder."""
    parts = F.split(F.regexp_replace(path, "^[a-z]+:/*", "/"), "/")
    return suffix(path).isin(*DOCUMENT_SUFFIXES, *(f".{s}" for s in SOURCE_SUFFIXES)) & ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED]))


def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 with bad bytes left out, which neither casts nor ``decode`` do."""
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def read_repository(spark: SparkSession, root: str, repo: str | None = None, pdf_text: Callable[[bytes], str] | None = None) -> DataFrame:
    """(repo, path, root, signature, text) of the supported files below ``root``; ValueError if absent.

    PDF files are read with ``pdf_text``, which gives the text of one file's bytes; without it
    they are left out, as their bytes are no text.
    """
    if not root:
        raise ValueError("a source path is needed")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = files.filter(supported(F.col("path")))
    is_pdf = suffix(F.col("path")).isin(*PDF_SUFFIXES)
    text = F.pandas_udf(decoded, "string")("content")
    if pdf_text is None:
        kept = kept.filter(~is_pdf)
    else:

        def extracted(content: pd.Series) -> pd.Series:
            return content.map(lambda b: pdf_text(bytes(b)) if b is not None else None)

        text = F.when(is_pdf, F.pandas_udf(extracted, "string")(F.when(is_pdf, F.col("content")))).otherwise(text)
    signature = F.concat_ws(":", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))
    name = repo or root.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git")
    plain = F.regexp_replace("path", "^file:/*", "/")
    base = re.sub("^file:/*", "/", root).rstrip("/")
    return kept.select(F.lit(name).alias("repo"), plain.alias("path"), F.lit(base).alias("root"), signature.alias("signature"), text.alias("text"))
