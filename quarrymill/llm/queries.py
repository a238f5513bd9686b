"""The operators bound to the tables of a data folder, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import ann, bpe, chosen_path, collocations, hilbert, licenses, lines, mixing, ownership, quotes, range_join, toxicity, trie
from quarrymill.llm.common import checkpointed, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The tokenizer file of the registered queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Rows that Python workers of the registered queries get at once: documents are long, and the
#: default of 10,000 rows crowds small executors.  Operators leave the session as it is.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches for the registered queries and the pipeline."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def op1_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors.filter(F.col("vec_id") % 20 == 0), vectors)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op3_vector_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join.range_join(table(spark, sf_dir, "embeddings"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are read once: what is left of them is a count
    docs = checkpointed(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", mixing.token_count(F.col("text")).alias("tokens")))
    dims = {"source": F.col("row.source"), "lang": F.col("row.lang"), "topic": F.col("topic")}
    out = mixing.mixed(mixing.with_topics(docs, table(spark, sf_dir, "embeddings")), F.col("row.tokens"), dims)
    return out.select("row.doc_id", "source", "lang", "topic", "tokens", "probability", "weight", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op7_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership.secret_scan(table(spark, sf_dir, "documents"))


def quoted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking over conversations whose turns quote the two turns before them, at two levels."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def before(n: int) -> DataFrame:
        marks = ">" * n + " "
        lines = F.concat(F.lit(marks), F.replace("said", F.lit("\n"), F.lit(f"\n{marks}")), F.lit("\n"))
        return said.select("conv_id", (F.col("turn") + n).alias("turn"), lines.alias(f"before{n}"))

    joined = messages.join(before(2), ["conv_id", "turn"], "left").join(before(1), ["conv_id", "turn"], "left")
    text = F.concat(F.coalesce("before2", F.lit("")), F.coalesce("before1", F.lit("")), F.coalesce("text", F.lit("")))
    return quotes.reply_ordered(joined.select("conv_id", "turn", "role", text.alias("text")))


#: The same derivation in DuckDB, before the SQL of quotation linking.
_QUOTED = """WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY 1, 2),
quoted AS (
  SELECT c.conv_id, c.turn, role, coalesce('>> ' || replace(b.said, chr(10), chr(10) || '>> ') || chr(10), '') || coalesce('> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10), '') || coalesce(text, '') AS text
  FROM conversations c LEFT JOIN said a ON a.conv_id = c.conv_id AND a.turn + 1 = c.turn LEFT JOIN said b ON b.conv_id = c.conv_id AND b.turn + 2 = c.turn
), m AS"""


def queries() -> dict[str, Query]:
    own = (
        op1_inner_product_search, op2_license_scan, op3_vector_range_join, op4_source_mixing, op5_line_dedup,
        op6_quotation_linking, op7_toxic_passages, op8_hilbert_sharding, op9_bpe_round_trip, op10_shingle_join, op11_phrase_collocations, op12_prefix_trie, op13_secret_ownership, quoted_turns,
    )
    return {f.__name__: _batched(f) for f in own}


def _batched(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    return {
        "op1_inner_product_search": ann.ORACLE,
        "op3_vector_range_join": range_join.ORACLE,
        "op5_line_dedup": lines.ORACLE,
        "op6_quotation_linking": quotes.ORACLE,
        "op10_shingle_join": chosen_path.ORACLE,
        "op11_phrase_collocations": collocations.ORACLE,
        "op12_prefix_trie": trie.ORACLE,
        "op13_secret_ownership": ownership.ORACLE,
        "quoted_turns": quotes.ORACLE.replace("FROM conversations),", "FROM quoted),").replace("WITH RECURSIVE m AS", _QUOTED),
    }
