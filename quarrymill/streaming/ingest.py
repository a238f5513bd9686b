"""Continuous ingest of documents that arrive as Parquet files (an extension of batch ingest)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import columns
from quarrymill.operators.chunking import ChunkSizes, chunks
from quarrymill.operators.documents import markdown_sections
from quarrymill.session import materialized
from quarrymill.sources.store import ChunkStore


def chunk_documents(docs: DataFrame, sizes: ChunkSizes | None = None) -> DataFrame:
    """Chunks of documents (path, text): the same plan in batch and in each micro-batch."""
    hashed = docs.filter("path IS NOT NULL").select("path", F.sha2("text", 256).alias("source_hash"), "text")
    sections = markdown_sections(hashed, ("path", "source_hash"))
    return chunks(sections.withColumn("language", F.lit("markdown")), sizes)


def latest(batch: DataFrame, key: list[str]) -> DataFrame:
    """One row for each file of a micro-batch: that of the greatest ``version`` where there is such a column."""
    if "version" not in batch.columns:
        return batch.dropDuplicates(key)
    return batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in key]), "version").alias("v")).select(*key, "v.*")


def apply_batch(store: ChunkStore, collection: str, batch: DataFrame, make: Callable[[DataFrame], DataFrame] = chunk_documents, key: str | Sequence[str] = "path") -> None:
    """Brings a collection up to date with files that arrived; a file with a null ``text`` is deleted.

    ``<collection>_files`` keeps the chunk ids of each file, so a file that arrives again loses its old
    chunks.  Both tables change in one transaction, and a batch that comes twice changes nothing more.
    """
    keys, files = columns(key), f"{collection}_files"
    now = materialized(latest(batch, keys))
    chunks = materialized(make(now.filter("text IS NOT NULL")).dropDuplicates(["id"]))
    with store.transaction() as change:
        held = change.lookup(files, now)
        old = None if held is None else materialized(held.select(F.explode("chunk_ids").alias("id")))
        change.merge(collection, chunks, old)
        change.merge(files, chunks.groupBy(*keys).agg(F.collect_set("id").alias("chunk_ids")), now.select(*keys), key=keys)


def stream_into(spark: SparkSession, source: str, schema, store: ChunkStore, collection: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = chunk_documents):
    """A query that chunks arriving files, replaces the chunks of those that changed and drops those of deleted ones."""

    def write(batch: DataFrame, _: int) -> None:
        apply_batch(store, collection, batch, make)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
