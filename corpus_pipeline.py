"""A corpus pipeline over the table ``documents``: five stages, one operator each.

Every stage takes what its predecessor kept and returns the columns of ``documents``; the last
returns token ids.  ``run`` cuts the lineage between stages by checkpoints.

Edge cases, in every stage: null and empty texts are empty documents (one of them stays as near
copy of the others); rows with a null id, and rows that repeat an id, are documents of their own
until they are near copies; an empty table gives no rows; columns besides those of ``documents``
stay as they are, whatever their names.  A document of which line dedup drops every line stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import bpe, chosen_path, lines, mixing, toxicity
from quarrymill.llm.common import checkpointed, table
from quarrymill.llm.queries import small_batches, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects; it is fitted on labelled ones."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in the first document that holds them; every document stays."""
    small_batches(spark)
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return lines.without_shared(docs).select(row.alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    small_batches(spark)
    return chosen_path.near_unique(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with tempered shares of sources, languages and topics."""
    small_batches(spark)
    return mixing.sampled(docs, table(spark, sf_dir, "embeddings"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    small_batches(spark)
    return bpe.digested(docs, vocabulary(), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("BPE", encode_tokens),
]

#: Chosen paths, raking and segments are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
