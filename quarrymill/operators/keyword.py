"""Keyword search: an Okapi index as tables, and ranking with filters after scoring."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import TERM, terms

#: Okapi parameters: saturation, length weight, and the share of the mean idf for common terms.
K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class KeywordIndex:
    """postings (id, term, tf), lengths (id, dl), idf (term, n, idf) and totals (one row)."""

    postings: DataFrame
    lengths: DataFrame
    idf: DataFrame
    totals: DataFrame

    @classmethod
    def of(cls, postings: DataFrame, lengths: DataFrame) -> KeywordIndex:
        """The statistics of given postings; texts are not read again."""
        totals = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        return cls(postings, lengths, inverse_frequencies(postings.groupBy("term").agg(F.count("*").alias("n")), totals), totals)

    def without(self, ids: DataFrame) -> KeywordIndex:
        """Less the documents whose ``id`` is given."""
        gone = ids.select("id").distinct()
        return KeywordIndex.of(self.postings.join(gone, "id", "left_anti"), self.lengths.join(gone, "id", "left_anti"))

    def with_documents(self, docs: DataFrame, key: str = "id", text: str = "text") -> KeywordIndex:
        """With documents added; those whose id is there already are replaced."""
        rest, new = self.without(docs.select(F.col(key).alias("id"))), build_index(docs, key, text)
        return KeywordIndex.of(rest.postings.unionByName(new.postings), rest.lengths.unionByName(new.lengths))

    def kept(self, keep: Callable[[DataFrame], DataFrame]) -> KeywordIndex:
        """The same with every table put through ``keep``, which writes it once."""
        return KeywordIndex(*(keep(t) for t in (self.postings, self.lengths, self.idf, self.totals)))


def inverse_frequencies(n: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, n, idf) of terms and the documents that have them.

    The mean idf takes negative values in; negative ones are then replaced by a share of it.
    """
    raw = n.crossJoin(F.broadcast(totals.select("n_docs"))).withColumn("raw", F.log(F.col("n_docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "n", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def build_index(docs: DataFrame, key: str = "id", text: str = "text") -> KeywordIndex:
    """Postings by one aggregation on (id, term); statistics aggregate the postings."""
    tokenised = docs.select(F.col(key).alias("id"), terms(F.coalesce(text, F.lit(""))).alias("terms"))
    lengths = tokenised.select("id", F.size("terms").alias("dl"))
    postings = tokenised.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return KeywordIndex.of(postings, lengths)


def query_index(docs: DataFrame, query: str, key: str = "id", text: str = "text") -> KeywordIndex:
    """The index that one query needs, made without a shuffle by document.

    Postings are those of the query's terms, counted inside each row; document frequencies are
    one aggregation by term over the distinct terms of each row.
    """
    asked = sorted(set(re.findall(TERM, query.lower())))
    tokenised = docs.select(F.col(key).alias("id"), terms(F.coalesce(text, F.lit(""))).alias("terms"))
    lengths = tokenised.select("id", F.size("terms").alias("dl"))
    counts = F.transform(
        F.array(*[F.lit(t) for t in asked]).cast("array<string>"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).cast("long").alias("tf"))
    )
    postings = tokenised.select("id", F.explode(F.filter(counts, lambda c: c["tf"] > 0)).alias("c")).select("id", "c.term", "c.tf")
    n = tokenised.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    totals = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return KeywordIndex(postings, lengths, inverse_frequencies(n, totals), totals)


def query_terms(spark, query: str) -> DataFrame:
    """The query's terms with their number of occurrences; its size is the query's."""
    found = Counter(re.findall(TERM, query.lower()))
    return spark.createDataFrame(sorted(found.items()), "term string, times long")


def scores(index: KeywordIndex, query: str) -> DataFrame:
    """(id, score) of documents with any query term; others score 0 and are not listed."""
    asked = F.broadcast(query_terms(index.postings.sparkSession, query))
    hits = index.postings.join(asked, "term").join(index.idf.join(asked.select("term"), "term", "left_semi"), "term")
    sized = hits.join(index.lengths, "id").crossJoin(F.broadcast(index.totals))
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return sized.groupBy("id").agg(F.sum(part).alias("score"))


def keyword_search(
    index: KeywordIndex, chunks: DataFrame, query: str, limit: int, key: str = "id", order: Column | None = None, where: Column | None = None
) -> DataFrame:
    """The best ``limit`` chunks that satisfy ``where``, scores of 0 or less included.

    Statistics are those of the whole index: the filter applies after scoring.  Ties keep the
    order of ``order`` (the key by default).
    """
    scored = chunks.join(scores(index, query).withColumnRenamed("id", "_id"), F.col(key) == F.col("_id"), "left").drop("_id")
    scored = scored.withColumn("score", F.coalesce("score", F.lit(0.0)))
    kept = scored if where is None else scored.filter(where)
    return kept.orderBy(F.desc("score"), order if order is not None else F.col(key)).limit(limit)


def chunk_filter(repo: str | None = None, language: str | None = None, section: str | None = None) -> Column:
    """Repository and language exactly; section as a substring of the joined hierarchy in lower case."""
    out = F.lit(True)
    if repo:
        out = out & (F.col("repo") == repo)
    if language:
        out = out & (F.col("language") == language)
    if section:
        out = out & F.contains(F.lower(F.array_join("section_hierarchy", " ")), F.lit(section.lower()))
    return out
