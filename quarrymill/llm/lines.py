"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

The index keeps, for every line key, exact reference counts by document (the postings).  For
each shard of keys a cuckoo filter holds the keys that at least two documents share: it answers
for most lines, without touching the counts, that they are not shared.  Lines that the filter
may know are looked up exactly.  Inserting documents adds keys whose count rises to two;
deleting documents takes out keys whose count falls below two, so a line returns to the next
document that holds it.

Edge cases: null and empty texts are one empty line; documents with a null id keep all lines
and count nowhere; rows that repeat an id are one document, each row keeps its own text; a line
of one document that repeats inside it is not shared; keys have whole lines of any length;
an empty table gives no rows; extra columns are not read by the index and, whatever their names,
come back untouched in ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed, hash128, packed
from quarrymill.llm.cuckoo import CuckooFilter

#: Least code points of a key, keys in a shard's filter about, and lines probed by a task about.
LEAST_CHARS, SHARD_KEYS, TASK_LINES = 10, 200_000, 100_000
#: What is stripped from lines, and the letters lower-cased.
STRIPPED, UPPER = " \t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(STRIPPED)), UPPER, UPPER.lower())


def postings_of(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """A row for each line of each document that has a key: doc_id, row, pos, h1, h2.

    ``row`` tells rows with one id apart by their text; (h1, h2) is a 128-bit hash of the key.
    """
    text = F.coalesce("text", F.lit(""))
    lines = docs.filter("doc_id is not null").select("doc_id", F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= least)
    h1, h2 = hash128(F.col("key"))
    return keyed.select("doc_id", "row", "pos", h1.alias("h1"), h2.alias("h2"))


def shared_keys(postings: DataFrame) -> DataFrame:
    """Keys that two documents or more hold, with the least of those documents."""
    counts = postings.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("_last"))
    return counts.filter("first_doc < _last").drop("_last")


def _shard(shards: int) -> Column:
    return F.pmod("h1", F.lit(shards)).cast("int")


def _filter_rows(shard: int, made: CuckooFilter) -> pd.DataFrame:
    blobs = made.dumps()
    return pd.DataFrame({"shard": [shard] * len(blobs), "layer": range(len(blobs)), "slots": blobs})


FILTER_SCHEMA = "shard int, layer int, slots binary"


@dataclass
class LineIndex:
    """Postings (one row for each document and key), shared keys, and the shards' filters.

    All three are DataFrames that were checkpointed or read from tables; ``save`` and ``load``
    keep them in a folder.  Methods give a new index.
    """

    postings: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, shards: int | None = None) -> LineIndex:
        return cls.of(checkpointed(postings_of(docs)), shards)

    @classmethod
    def of(cls, postings: DataFrame, shards: int | None = None) -> LineIndex:
        return cls._sharded(postings, checkpointed(shared_keys(postings)), shards)

    @classmethod
    def _sharded(cls, postings: DataFrame, shared: DataFrame, shards: int | None = None) -> LineIndex:
        """The index with filters made anew, for as many shards as the shared keys need."""
        shards = shards or 1 + shared.count() // SHARD_KEYS

        def made(key, rows):
            cuckoo = CuckooFilter.sized(len(rows))
            cuckoo.insert(rows.h1.to_numpy(), rows.h2.to_numpy())
            return _filter_rows(key[0], cuckoo)

        filters = shared.withColumn("shard", _shard(shards)).select("shard", "h1", "h2").groupBy("shard").applyInPandas(made, FILTER_SCHEMA)
        return cls(postings, shared, checkpointed(filters), shards)

    def save(self, folder: str) -> None:
        for name in ("postings", "shared", "filters"):
            getattr(self, name).withColumn("shards", F.lit(self.shards)).write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark, folder: str) -> LineIndex:
        parts = [spark.read.parquet(f"{folder}/{name}") for name in ("postings", "shared", "filters")]
        known = next((r["shards"] for r in (p.select("shards").first() for p in reversed(parts)) if r), 1)
        return cls(*(p.drop("shards") for p in parts), known)

    def _updated(self, postings: DataFrame, touched: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """The index over new postings, when only keys of ``touched`` may have changed.

        Counts are taken for touched keys alone; filters change by the keys that crossed two.
        Where shards hold more than twice ``shard_keys`` keys, they are dealt out anew.
        """
        touched = checkpointed(touched.select("h1", "h2").distinct())
        now = checkpointed(shared_keys(postings.join(touched, ["h1", "h2"], "left_semi")))
        before = self.shared.join(touched, ["h1", "h2"], "left_semi")
        change = (
            now.join(before, ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(True).alias("add"))
            .union(before.join(now, ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(False)))
            .withColumn("shard", _shard(self.shards))
        )

        def changed(key, old, rows):
            add, h1, h2 = rows["add"].to_numpy(bool), rows.h1.to_numpy(np.int64), rows.h2.to_numpy(np.int64)
            blobs = old.sort_values("layer").slots.tolist()
            cuckoo = CuckooFilter.loads(blobs) if blobs else CuckooFilter.sized(2 * int(add.sum()))
            cuckoo.delete(h1[~add], h2[~add])
            cuckoo.insert(h1[add], h2[add])
            return _filter_rows(int(key[0]), cuckoo)

        shared = checkpointed(self.shared.join(touched, ["h1", "h2"], "left_anti").union(now.select(*self.shared.columns)))
        if shared.count() > 2 * self.shards * shard_keys:  # shards have outgrown a task
            return LineIndex._sharded(postings, shared, 1 + shared.count() // shard_keys)
        filters = self.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(changed, FILTER_SCHEMA)
        return LineIndex(postings, shared, checkpointed(filters), self.shards)

    def insert(self, docs: DataFrame, shard_keys: int = SHARD_KEYS) -> LineIndex:
        """With the documents added; an id already present gets the further lines."""
        new = checkpointed(postings_of(docs))
        return self._updated(self.postings.union(new), new, shard_keys)

    def remove(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents whose ``doc_id`` is given."""
        ids = doc_ids.select("doc_id").distinct()
        gone = self.postings.join(ids, "doc_id", "left_semi")
        return self._updated(checkpointed(self.postings.join(ids, "doc_id", "left_anti")), gone)

    def maybe_shared(self, postings: DataFrame) -> DataFrame:
        """The postings that the filters do not rule out.

        A shard's lines are dealt over several tasks by their document, each with the shard's
        filter, so that a line which very many documents hold fills no single task.
        """
        lines = postings.count()
        deals = 1 + lines // (TASK_LINES * self.shards)

        def probed(key, filters, rows):
            if not len(filters) or not len(rows):
                return rows.iloc[:0].drop(columns=["shard", "deal"])
            cuckoo = CuckooFilter.loads(filters.sort_values("layer").slots.tolist())
            return rows[cuckoo.contains(rows.h1.to_numpy(np.int64), rows.h2.to_numpy(np.int64))].drop(columns=["shard", "deal"])

        dealt = postings.withColumns({"shard": _shard(self.shards), "deal": F.pmod(F.xxhash64("doc_id", "row"), F.lit(deals)).cast("int")})
        every = self.filters.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        return every.groupBy("shard", "deal").cogroup(dealt.groupBy("shard", "deal")).applyInPandas(probed, postings.schema)

    def dropped(self, postings: DataFrame | None = None) -> DataFrame:
        """Lines that a smaller document holds too, as doc_id, row and ``drop`` (their places).

        What the filters let through is joined to the exact keys; the join is the only place
        where a frequent line's rows meet, and Spark can split it there.
        """
        maybe = self.maybe_shared(self.postings if postings is None else postings)
        known = maybe.join(self.shared, ["h1", "h2"]).filter("doc_id > first_doc")
        return known.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def _kept(text: Column, drop: Column) -> Column:
    """A text less the lines at the places ``drop``; the lines are split once and picked by place."""
    lines = F.split(text, "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    picked = F.transform(F.array(lines), lambda x: F.array_join(F.transform(places, lambda k: F.get(x, k)), "\n"))
    return F.when(drop.isNull(), text).otherwise(F.get(picked, F.lit(0)))


def without_shared(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, with ``kept`` (its text without shared lines), ``n_lines`` and ``n_dropped``."""
    index = index or LineIndex.build(docs)
    text = F.coalesce("text", F.lit(""))
    drops = index.dropped().withColumnsRenamed({"doc_id": "drop_id", "row": "drop_row"})
    keyed = packed(docs, id=F.col("doc_id"), text_row=F.xxhash64(text))
    text = F.coalesce("row.text", F.lit(""))
    joined = keyed.join(drops, (F.col("id") == F.col("drop_id")) & (F.col("text_row") == F.col("drop_row")), "left")
    return joined.select(
        "row", _kept(text, F.col("drop")).alias("kept"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    out = without_shared(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB, over the view ``documents``.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE first_doc < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first_doc IS NULL OR first_doc >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id
"""
