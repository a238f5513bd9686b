"""Hybrid retrieval: merging of candidate lists, score bounds, reranking and result rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import terms
from quarrymill.session import materialized

MODES = ("hybrid", "dense", "keyword")
#: Result limits, candidates for each result, and bounds of the number of candidates.
LEAST_RESULTS, MOST_RESULTS, PER_RESULT, LEAST_CANDIDATES, MOST_CANDIDATES = 1, 25, 3, 20, 40


@dataclass(frozen=True)
class QueryRequest:
    query: str
    repo: str | None = None
    limit: int = 10
    mode: str = "hybrid"
    language: str | None = None
    section: str | None = None
    heading: str | None = None

    def __post_init__(self):
        if not LEAST_RESULTS <= self.limit <= MOST_RESULTS:
            raise ValueError(f"limit must be between {LEAST_RESULTS} and {MOST_RESULTS}")
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")

    @property
    def candidates(self) -> int:
        return min(max(self.limit * PER_RESULT, LEAST_CANDIDATES), MOST_CANDIDATES)


def candidate_list(ranked: DataFrame, source: str, key: str = "id") -> DataFrame:
    """(id, score, source, seq) of a ranked list; ``seq`` is its order."""
    order = Window.orderBy(F.desc("score"), key)  # of at most MOST_CANDIDATES rows
    return ranked.select(F.col(key).alias("id"), "score", F.lit(source).alias("source"), F.row_number().over(order).alias("seq"))


def normalized_score(score: Column, low: Column, high: Column) -> Column:
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - low) / (high - low)))
    return F.when(high <= low, F.when(score > 0, 1.0).otherwise(0.0)).otherwise(scaled)


def merge(candidates: DataFrame) -> DataFrame:
    """Candidates (id, score, source, seq) of both legs to one row for each id.

    Scores are summed, scores scaled by their source's bounds are summed up to 1, sources are
    joined; ``first_seen`` keeps the order of appearance, dense before keyword.  The candidates, which
    are few, are written once, as both their bounds and their scores are read.
    """
    candidates = materialized(candidates)
    bounds = candidates.groupBy("source").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = candidates.join(F.broadcast(bounds), "source").withColumn("part", normalized_score(F.col("score"), F.col("low"), F.col("high")))
    appeared = F.when(F.col("source") == "dense", F.col("seq")).otherwise(F.col("seq") + MOST_CANDIDATES)
    return scaled.groupBy("id").agg(
        F.sum("score").alias("score"),
        F.least(F.lit(1.0), F.sum("part")).alias("normalized_score"),
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"),
        F.min(appeared).alias("first_seen"),
    )


def metadata_bonus(chunk_type: Column, framework: Column, hierarchy: Column) -> Column:
    return (
        F.when(chunk_type == "architecture", 0.15).otherwise(0.0)
        + F.when(F.coalesce(framework, F.lit("")) != "", 0.05).otherwise(0.0)
        + F.when(F.coalesce(F.size(hierarchy), F.lit(0)) > 0, 0.05).otherwise(0.0)
    )


def lexical_overlap(query: str, text: Column) -> Column:
    """Number of distinct terms that query and text share."""
    return F.size(F.array_intersect(terms(F.lit(query)), terms(F.coalesce(text, F.lit("")))))


def metadata_boost(query: str, headings: Column, section: Column, symbols: Column, framework: Column, chunk_type: Column) -> Column:
    asked = terms(F.lit(query))
    shares = lambda column: F.size(F.array_intersect(asked, terms(F.coalesce(column, F.lit(""))))) > 0
    named = (F.coalesce(framework, F.lit("")) != "") & F.contains(F.lower(F.lit(query)), framework)
    return (
        F.when(shares(F.array_join(headings, " ")), 0.4).otherwise(0.0)
        + F.when(shares(section), 0.3).otherwise(0.0)
        + F.when(shares(F.array_join(symbols, " ")), 0.2).otherwise(0.0)
        + F.when(F.coalesce(named, F.lit(False)), 0.2).otherwise(0.0)
        + F.when(chunk_type.isin("architecture", "config"), 0.1).otherwise(0.0)
    )


def confidence_band(normalized: Column) -> Column:
    return F.when(normalized >= 0.75, "high").when(normalized >= 0.45, "medium").otherwise("low")


def reranked(merged: DataFrame, chunks: DataFrame, query: str, limit: int, key: str = "id") -> DataFrame:
    """Merged candidates with their chunk columns, reranked and shaped as results.

    Ties of the rerank score keep the order by scaled score, score and first appearance.
    """
    rows = merged.join(chunks.withColumnRenamed(key, "id"), "id").withColumn(
        "score", F.col("score") + metadata_bonus(F.col("chunk_type"), F.col("framework_type"), F.col("section_hierarchy"))
    )
    order = Window.orderBy(F.desc("normalized_score"), F.desc("score"), "first_seen")  # of at most 2 * MOST_CANDIDATES rows
    boost = metadata_boost(query, F.col("heading_hierarchy"), F.col("section"), F.col("symbols"), F.col("framework_type"), F.col("chunk_type"))
    scored = rows.withColumns(
        {"merge_rank": F.row_number().over(order), "rerank_score": lexical_overlap(query, F.col("text")) + 0.05 * F.col("score") + boost}
    )
    top = scored.orderBy(F.desc("rerank_score"), "merge_rank").limit(limit)
    origin = F.concat(F.coalesce("repo", F.lit("")), F.lit(":"), "path", F.lit("#"), F.coalesce("section", F.lit("")))
    return top.withColumns({"confidence": confidence_band(F.col("normalized_score")), "origin": origin})


def summary_of(found: DataFrame, chars: int, symbols: int) -> DataFrame:
    """One row about the best results of a repository: texts of the first five, files, modules and frameworks."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("rerank_score")).alias("s"), "merge_rank", F.substring("text", 1, chars).alias("text"))))
    return found.agg(
        F.array_join(F.transform(F.slice(rows, 1, 5), lambda r: r["text"]), "\n\n").alias("architecture_overview"),
        F.array_sort(F.collect_set("path")).alias("important_files"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))), 1, symbols).alias("major_modules"),
        F.array_sort(F.collect_set("framework_type")).alias("frameworks"),
    )
