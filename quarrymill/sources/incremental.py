"""Incremental ingest: which files are new, changed, unchanged or stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_changes(current: DataFrame, manifest: DataFrame, force: bool = False, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Keys, ``status`` and ``removed`` chunks, by a full outer join of signatures.

    ``manifest`` has the keys, signature and n_chunks.  Skipped files keep their chunks; changed
    and stale ones lose them; with ``force`` every present file counts as changed or new.
    """
    old = manifest.select(*keys, F.col("signature").alias("_old"), F.col("n_chunks").alias("_n"))
    rows = current.select(*keys, "signature").join(old, list(keys), "full_outer")
    same = (F.col("signature") == F.col("_old")) & F.lit(not force)
    status = F.when(F.col("signature").isNull(), "stale").when(F.col("_old").isNull(), "new").when(same, "skipped").otherwise("changed")
    removed = F.when(status.isin("stale", "changed"), F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return rows.select(*keys, status.alias("status"), removed.alias("removed"))


def ingest_counts(changes: DataFrame) -> DataFrame:
    """One row: files parsed, skipped and stale, and chunks removed."""
    is_ = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("long")), F.lit(0))
    return changes.agg(
        is_("new", "changed").alias("parsed"), is_("skipped").alias("skipped"), is_("stale").alias("stale"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed")
    )
