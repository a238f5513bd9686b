"""Keyword search that ends early: postings in blocks with the greatest score of each.

Documents in the order of their keys are cut into ranges of ``RANGE``; the postings of a term in a
range are a block with the greatest score that the term gives there.  The sum of these, over a
query's terms, bounds every document of the range.  A search reads the small columns of its terms'
blocks, scores the ranges with the greatest bounds, and then only those whose bound reaches the
score that the last place has by then.  The result is exactly that of ``keyword.keyword_search``.

Blocks are sorted by term and range, so written to Parquet a query's terms prune its row groups.

``written_blocks`` makes blocks of documents and keeps nothing else: a task counts the terms of a
range in memory, so that postings are shuffled as blocks, once.  Which documents share a range
plays no part in the results; there it is those that a task reads after one another.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quarrymill.functions.text import TERM
from quarrymill.operators import keyword
from quarrymill.operators.keyword import K1, B, KeywordIndex, query_terms
from quarrymill.session import materialized, shared_folder

#: Documents of a range, a power of two.
RANGE = 1024
#: Ranges that are scored before the last place's score is known.
FIRST_RANGES = 8
#: Ranges that are named in the filter of a scan; more are joined.
NAMED_RANGES = 2000
#: Share by which a bound may lie below a score and still be read, as sums of doubles depend on their order.
SLACK = 1e-9


@dataclass
class BlockIndex:
    """The keyword index with blocks (term, range, top, n, ids, tfs, dls).

    With ``ranges`` (range, ids, dls) the blocks are (term, range, most, n, codes) instead: ``most`` bounds
    what a score is of the term's idf, and a code is the frequency times ``size`` plus the document's place in the range.
    """

    index: KeywordIndex
    blocks: DataFrame
    ranges: DataFrame | None = None
    size: int = RANGE

    def tops(self, terms: list[str]) -> DataFrame:
        """(term, range, top) of the blocks of some terms; no top is below 0 where it is made of a bound."""
        some = self.blocks.filter(F.col("term").isin(terms))
        if self.ranges is not None:
            idf = F.broadcast(self.index.idf.filter(F.col("term").isin(terms)).select("term", "idf"))  # a row for each of the terms
            some = some.select("term", "range", "most").join(idf, "term").withColumn("top", F.greatest(F.col("idf"), F.lit(0.0)) * F.col("most"))
        return some.select("term", "range", "top")

    def rows(self, blocks: DataFrame, *columns: str) -> DataFrame:
        """The postings of some blocks: the columns named, and ``p`` of ids, tfs and dls."""
        if self.ranges is None:
            return blocks.select(*columns, F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        size = F.lit(self.size)
        place = F.pmod("code", size)
        coded = blocks.join(self.ranges, "range").select(*columns, "ids", "dls", F.explode("codes").alias("code"))
        return coded.select(*columns, F.struct(F.get("ids", place).alias("ids"), F.floor(F.col("code") / size).alias("tfs"), F.get("dls", place).alias("dls")).alias("p"))

    def kept(self, keep: Callable[[DataFrame], DataFrame]) -> BlockIndex:
        return BlockIndex(self.index.kept(keep), keep(self.blocks), None if self.ranges is None else keep(self.ranges), self.size)


@dataclass
class Found:
    """The best rows, and how many of the query's blocks were read for them."""

    rows: DataFrame
    blocks_read: int
    blocks: int


def build_blocks(index: KeywordIndex, size: int = RANGE) -> BlockIndex:
    """Blocks of an index; a block holds at most ``size`` postings, so a frequent term has many."""
    ordered = materialized(index.lengths.repartitionByRange("id").sortWithinPartitions("id"))
    ranged = ordered.withColumn("range", F.shiftright(F.monotonically_increasing_id(), size.bit_length() - 1))
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = index.postings.join(ranged, "id").join(index.idf, "term").crossJoin(F.broadcast(index.totals)).withColumn("score", score)
    rows = F.array_sort(F.collect_list(F.struct("id", "tf", "dl")))
    blocks = scored.groupBy("term", "range").agg(F.max("score").alias("top"), F.count("*").alias("n"), rows.alias("rows"))
    cut = blocks.select("term", "range", "top", "n", *[F.col(f"rows.{c}").alias(f"{c}s") for c in ("id", "tf", "dl")])
    return BlockIndex(index, cut.repartitionByRange("term", "range").sortWithinPartitions("term", "range"))


def _counted(kind: pa.DataType, avgdl: float, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Coded blocks of the documents (id, text in lower case) of a partition, and a row without a term for each range."""
    names = ["term", "range", "most", "codes", "ids", "dls"]

    def closed(at: int, ids: list, dls: list[int], found: dict[str, list[int]]) -> pa.RecordBatch:
        terms = sorted(found)
        codes = [found[t] for t in terms]
        share = lambda code: (tf := code // size) * (K1 + 1) / (tf + K1 * (1 - B + B * dls[code % size] / avgdl))
        most = [max(map(share, c)) for c in codes]
        nulls = [None] * len(terms)
        kinds = (pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(kind), pa.list_(pa.int32()))
        values = ([*terms, None], [at] * (len(terms) + 1), [*most, None], [*codes, None], [*nulls, ids], [*nulls, dls])
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, dls, found = TaskContext.get().partitionId() << 33, [], [], {}
        for batch in batches:
            for key, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                counts, place = Counter(re.findall(TERM, text.as_py())), len(ids)
                for term, tf in counts.items():
                    if term in found:
                        found[term].append(tf * size + place)
                    else:
                        found[term] = [tf * size + place]
                ids.append(key)
                dls.append(counts.total())
                if len(ids) == size:
                    yield closed(at, ids, dls, found)
                    at, ids, dls, found = at + 1, [], [], {}
        if ids:
            yield closed(at, ids, dls, found)

    return run


def written_blocks(docs: DataFrame, key: str = "id", text: str = "text", size: int = RANGE) -> BlockIndex:
    """Blocks of all terms of documents, written to the shared folder; postings are read from them.

    Texts are read once for the mean length and once for their terms; a term's blocks are dealt
    over tasks by stretches of ranges.
    """
    spark, lower = docs.sparkSession, F.lower(F.coalesce(text, F.lit("")))
    totals = materialized(docs.agg(F.count("*").alias("n_docs"), F.avg(F.regexp_count(lower, F.lit(TERM))).alias("avgdl")))
    texts = docs.select(F.col(key).alias("id"), lower.alias("text"))
    of = texts.schema["id"].dataType.simpleString()
    schema = f"term string, range long, most double, codes array<int>, ids array<{of}>, dls array<int>"
    made = texts.mapInArrow(_counted(to_arrow_schema(texts.schema).field("id").type, totals.first()["avgdl"], size), schema)
    folder = shared_folder(spark, "blocks")
    made.repartition("term", F.shiftright("range", 33 + 5)).sortWithinPartitions("term", "range").write.option("compression", "zstd").parquet(folder)
    written = spark.read.schema(schema).parquet(folder)
    blocks = written.filter("term IS NOT NULL").select("term", "range", "most", F.size("codes").cast("long").alias("n"), "codes")
    ranges = written.filter("term IS NULL").select("range", "ids", "dls")
    idf = materialized(keyword.inverse_frequencies(blocks.groupBy("term").agg(F.sum("n").alias("n")), totals))
    lengths = ranges.select(F.explode(F.arrays_zip("ids", "dls")).alias("p")).select(F.col("p.ids").alias("id"), F.col("p.dls").alias("dl"))
    built = BlockIndex(KeywordIndex(blocks, lengths, idf, totals), blocks, ranges, size)
    built.index.postings = built.rows(blocks, "term").select(F.col("p.ids").alias("id"), "term", F.col("p.tfs").alias("tf"))
    return built


def _scores(built: BlockIndex, asked: DataFrame, terms: list[str], ranges: list[int] | DataFrame) -> DataFrame:
    """(id, score) of the documents in the ranges that have a query term."""
    blocks = built.blocks.filter(F.col("term").isin(terms))
    blocks = blocks.filter(F.col("range").isin(ranges)) if isinstance(ranges, list) else blocks.join(ranges, "range", "left_semi")
    weights = F.broadcast(built.index.idf.join(F.broadcast(asked), "term").select("term", "idf", "times"))  # a row for each of the query's terms
    rows = built.rows(blocks.join(weights, "term"), "idf", "times").crossJoin(F.broadcast(built.index.totals))
    tf, dl = F.col("p.tfs"), F.col("p.dls")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return rows.groupBy(F.col("p.ids").alias("id")).agg(F.sum(part).alias("score"))


def search(built: BlockIndex, chunks: DataFrame, query: str, limit: int, key: str = "id", where: Column | None = None, first: int = FIRST_RANGES) -> Found:
    """The best ``limit`` chunks that satisfy ``where``; ties keep the order of ``key``.

    Where fewer than ``limit`` of them score above 0 the bounds say nothing about the rest, and
    every chunk is ranked as ``keyword_search`` does it.
    """
    spark = chunks.sparkSession
    asked = query_terms(spark, query)
    terms = [r["term"] for r in asked.collect()]
    heads = built.tops(terms).join(F.broadcast(asked), "term")
    bounds = materialized(heads.groupBy("range").agg(F.sum(F.col("times") * F.greatest("top", F.lit(0.0))).alias("bound"), F.count("*").alias("n")))
    total = bounds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shown = (chunks if where is None else chunks.filter(where)).select(key)  # rows are fetched at the end, for the best alone

    def best(ranges) -> DataFrame:
        scored = _scores(built, asked, terms, ranges).filter("score > 0").withColumnRenamed("id", "_id")
        return materialized(shown.join(scored, F.col(key) == F.col("_id")).drop("_id").orderBy(F.desc("score"), key).limit(limit))

    start = [r["range"] for r in bounds.orderBy(F.desc("bound"), "range").limit(first).collect()]
    found = best(start)
    last = found.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = last["least"] if last["n"] == limit else 0.0
    rest = bounds.filter(~F.col("range").isin(start) & (F.col("bound") > 0) & (F.col("bound") >= least * (1 - SLACK)))
    n_rest = rest.agg(F.count("*").alias("ranges"), F.coalesce(F.sum("n"), F.lit(0)).alias("blocks")).first()
    read = n_rest["blocks"] + bounds.filter(F.col("range").isin(start)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n_rest["ranges"]:
        more = best([r["range"] for r in rest.collect()] if n_rest["ranges"] <= NAMED_RANGES else rest.select("range"))
        found = found.unionByName(more).orderBy(F.desc("score"), key).limit(limit)
    if found.count() < limit:
        return Found(keyword.keyword_search(built.index, chunks, query, limit, key, where=where), total, total)
    best_keys = F.broadcast(found.dropDuplicates([key]).withColumnRenamed(key, "_id"))  # ``limit`` rows at most
    rows = chunks if where is None else chunks.filter(where)
    return Found(rows.join(best_keys, F.col(key) == F.col("_id")).drop("_id").orderBy(F.desc("score"), key).limit(limit), read, total)
