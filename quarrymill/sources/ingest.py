"""Incremental ingest into a store: changed files parsed, stale chunks removed, jobs recorded."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import dense, keyword
from quarrymill.session import materialized
from quarrymill.sources.graph_store import GraphStore
from quarrymill.sources.incremental import file_changes, ingest_counts
from quarrymill.sources.store import BUCKETS, ChunkStore, Snapshot

KEYS = ("repo", "path")
MANIFEST = "repo string, path string, signature string, n_chunks long, chunk_ids array<string>"
JOB = "job_id string, status string, parsed long, skipped long, stale long, removed long, chunks long, errors array<string>, started timestamp, finished timestamp, files long, done long, updated timestamp"
#: Files that are parsed before the job's record says how far it is.
BATCH_FILES = 20_000


class Ingestion:
    """Collections of one store folder: chunks, postings, lengths, vectors, manifest and jobs.

    A run compares the files of its repositories with their manifest, parses those that are new or
    changed, and replaces their rows and those of files that are gone; other repositories stay as
    they are.  The manifest knows each file's chunk ids, so no table is read through.  All tables
    change in one transaction: a run that failed is as if it had not been, and its job says
    ``failed`` and holds the error.  With ``keep_graph`` the graph tables change with the chunks; it
    must be given from the first run on.
    """

    def __init__(self, spark: SparkSession, root: str, dim: int = dense.DIM, buckets: int = BUCKETS, batch_files: int = BATCH_FILES, keep_graph: bool = False):
        self.spark, self.store, self.dim, self.batch_files = spark, ChunkStore(spark, root, buckets), dim, batch_files
        self.graph = GraphStore(self.store) if keep_graph else None

    def table(self, name: str, at: Snapshot | None = None) -> DataFrame | None:
        return self.jobs() if name == "jobs" else self.store.scan(name, at)

    def jobs(self) -> DataFrame:
        """The records of all jobs, also of those that run."""
        names = [n for n in self.store._listed("_jobs") if n.endswith(".json") and not n.startswith(".")]
        rows = self.spark.read.schema(JOB).json([f"{self.store.root}/_jobs/{n}" for n in names]) if names else self.spark.createDataFrame([], JOB)
        return rows

    def job(self, job_id: str) -> DataFrame:
        """The record of a job; no rows if there is none."""
        return self.jobs().filter(F.col("job_id") == job_id)

    def run(
        self, files: DataFrame, chunked: Callable[[DataFrame], DataFrame], force: bool = False, job_id: str | None = None, repos: Iterable[str] | None = None
    ) -> str:
        """Brings the store up to date with ``files`` (repo, path, signature, text); returns the job's id.

        ``repos`` names the repositories that ``files`` hold whole (those of its rows by default); a
        repository without files must be named for its chunks to go.
        """
        record = {"job_id": job_id or str(uuid.uuid4()), "status": "running", "errors": [], "started": datetime.now(UTC).isoformat()}

        def say(**values) -> None:
            record.update(values, updated=datetime.now(UTC).isoformat())
            self.store.write_text(f"_jobs/{record['job_id']}.json", json.dumps(record), replace=True)

        say()
        try:
            self._update(files, chunked, force, repos, say)
        except Exception as error:
            say(status="failed", errors=[str(error)], finished=datetime.now(UTC).isoformat())
            raise
        say(status="completed", finished=datetime.now(UTC).isoformat())
        return record["job_id"]

    def _parsed(self, files: DataFrame, chunked: Callable[[DataFrame], DataFrame], n_files: int, say: Callable) -> DataFrame:
        """Chunks of the files, with their file's keys as ``_repo`` and ``_path``, made in batches that the job's record counts."""
        batches, made, done = max(1, -(-n_files // self.batch_files)), None, 0
        for k in range(batches):
            part = files if batches == 1 else files.filter(F.pmod(F.xxhash64(*KEYS), F.lit(batches)) == k)
            some = chunked(part)
            origin = [F.col(f"origin_{c}" if f"origin_{c}" in some.columns else c).alias(f"_{c}") for c in KEYS]
            some = materialized(some.select(*[c for c in some.columns if not c.startswith("origin_")], *origin))
            made = some if made is None else made.unionByName(some)
            done += part.count() if batches > 1 else n_files
            say(done=done, chunks=made.count())
        return made

    def _update(self, files: DataFrame, chunked: Callable[[DataFrame], DataFrame], force: bool, repos: Iterable[str] | None, say: Callable) -> None:
        keys = list(KEYS)
        with self.store.transaction() as change:
            given = sorted(set(repos)) if repos is not None else [r[0] for r in files.select("repo").distinct().collect()]
            manifest = change.scan("manifest")
            known = self.spark.createDataFrame([], MANIFEST) if manifest is None else manifest
            known = known.filter(F.col("repo").isin(given))
            changes = materialized(file_changes(files, known, force))
            counts = ingest_counts(changes).first().asDict()
            say(**counts, files=counts["parsed"] + counts["skipped"], done=0, chunks=0)
            touched = changes.filter("status <> 'skipped'").select(*keys)
            ids = materialized(known.join(touched, keys, "left_semi").select(F.explode("chunk_ids").alias("id")))
            fresh = materialized(files.join(changes.filter("status in ('new', 'changed')").select(*keys), keys, "left_semi"))
            made = self._parsed(fresh, chunked, counts["parsed"], say)
            chunks = made.drop("_repo", "_path")
            before = change.lookup("chunks", ids) if self.graph else None
            before = chunks.limit(0) if before is None else materialized(before)
            added = change.merge("chunks", chunks, ids)["added"]
            if self.graph:
                self.graph.update(change, before, chunks)
            index = keyword.build_index(chunks)
            change.merge("postings", index.postings, ids, unique=["id", "term"])
            change.merge("lengths", index.lengths, ids)
            change.merge("vectors", dense.hash_embedding(chunks, dim=self.dim), ids, unique=["id", "bucket"])
            held = made.groupBy(F.col("_repo").alias("repo"), F.col("_path").alias("path")).agg(F.collect_set("id").alias("chunk_ids"))
            none = F.array().cast("array<string>")
            now = fresh.select(*keys, "signature").join(held, keys, "left").withColumn("chunk_ids", F.coalesce("chunk_ids", none))
            change.merge("manifest", now.select(*keys, "signature", F.size("chunk_ids").cast("long").alias("n_chunks"), "chunk_ids"), touched, key=keys)
        say(chunks=added)
