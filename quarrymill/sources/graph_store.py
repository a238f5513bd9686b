"""A property graph that is kept up to date chunk by chunk.

Facts that follow from their key alone (repositories, calls, edges) have a support count; a fact
goes with its last support.  Facts whose value is that of the last chunk (classes, endpoints,
files) keep one row for each supporting chunk, and the value is worked out anew for the touched
keys.  Dependencies are joined again for the touched names only, and routes resolved for the
calls and endpoints that appeared.  Everything changes in the caller's transaction, and only the
buckets of touched keys are read and written.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import routes
from quarrymill.operators.graph import Graph, files_of, last_by, resolve_calls
from quarrymill.session import large, unsized
from quarrymill.sources.store import ChunkStore, Snapshot, Transaction

CALL = ["id", "method", "path", "normalized_path", "repo"]
DEPENDENCY = ["repo", "dep"]


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


class GraphStore:
    """The graph tables of a store, named ``graph_*``."""

    def __init__(self, store: ChunkStore):
        self.store = store

    def update(self, change: Transaction, gone: DataFrame, new: DataFrame) -> None:
        """Takes away the facts of the chunks ``gone``, as they were written, and adds those of ``new``."""
        old, now = Graph(gone), Graph(new)
        self._counted(change, "repos", ["id"], *(g._rows.select(F.col("repo").alias("id")) for g in (now, old)))
        self._counted(change, "belongs_to", ["src"], *(g._rows.select(F.col("path").alias("src"), F.col("repo").alias("dst")) for g in (now, old)))
        self._counted(change, "handles", ["src"], *(g._routed.filter("handler is not null").select(F.col("handler").alias("src"), F.col("id").alias("dst")) for g in (now, old)))
        self._counted(change, "makes", ["src"], *(g._called.filter("caller is not null").select(F.col("caller").alias("src"), F.col("id").alias("dst")) for g in (now, old)))
        calls = lambda g: g._called.select("id", "method", F.col("route").alias("path"), routes.normalized(F.col("route")).alias("normalized_path"), "repo")
        calls_in, calls_out = self._counted(change, "http_calls", ["id"], calls(now), calls(old))
        file_rows = lambda g: g._rows.select(F.col("path").alias("id"), "repo", "pos", "language", "framework_type")
        self._supported(change, "files", ["id"], file_rows(now), file_rows(old), lambda rows: files_of(rows.withColumnRenamed("id", "path")))
        endpoint = lambda g: g._routed.select("id", "method", F.col("route").alias("path"), "repo", "pos").distinct()
        ends = lambda rows: last_by(rows, ["id", "method", "path"], ["repo"]).withColumn("normalized_path", routes.normalized(F.col("path")))
        ends_in, ends_out = self._supported(change, "endpoints", ["id"], endpoint(now), endpoint(old), ends)
        defined = lambda g: g._defined.select("id", "name", "repo", "path", "kind", "pos").distinct()
        self._supported(change, "classes", ["id"], defined(now), defined(old), lambda rows: last_by(rows, ["id", "name", "repo", "path"], ["kind"]))
        self._dependencies(change, now, old)
        self._links(change, calls_in, calls_out, ends_in, ends_out)

    def _counted(self, change: Transaction, name: str, key: list[str], plus: DataFrame, minus: DataFrame, table: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Adds to support counts and takes from them; returns the facts that appeared and that went."""
        table, facts = table or f"graph_{name}", plus.columns
        delta = plus.withColumn("d", F.lit(1)).unionByName(minus.withColumn("d", F.lit(-1))).groupBy(*facts).agg(F.sum("d").alias("d")).filter("d <> 0")
        delta = large(delta)
        held = change.lookup(table, delta)
        held = _empty(delta.select(*facts, F.lit(0).cast("long").alias("n_support"))) if held is None else held
        both = large(delta.join(held, facts, "left").select(*facts, F.coalesce("n_support", F.lit(0).cast("long")).alias("before"), (F.coalesce("n_support", F.lit(0)) + F.col("d")).alias("n_support")))
        change.merge(table, both.filter("n_support > 0").select(*facts, "n_support"), both.select(*facts), key=key, unique=facts, match=facts)
        return both.filter("before = 0 and n_support > 0").select(*facts), both.filter("before > 0 and n_support <= 0").select(*facts)

    def _supported(self, change: Transaction, name: str, key: list[str], plus: DataFrame, minus: DataFrame, value) -> tuple[DataFrame, DataFrame]:
        """Replaces the supporting rows of chunks and works out the values of the touched keys; returns nodes that appeared or changed, and old ones."""
        table, support = f"graph_{name}", f"graph_{name}_support"
        plus, minus = large(plus), large(minus)
        touched = large(plus.select(*key).unionByName(minus.select(*key)).distinct())
        before = change.lookup(table, touched)
        row = [*key, "pos"] + (["repo"] if name == "files" else [])
        change.merge(support, plus, minus, key=key, unique=row, match=row)
        now = large(value(change.lookup(support, touched)))
        before = _empty(now) if before is None else large(before.select(*now.columns))
        change.merge(table, now, touched, key=key)
        return now.exceptAll(before), before.exceptAll(now)

    def _dependencies(self, change: Transaction, now: Graph, old: Graph) -> None:
        wanted = [g._wanted.select("repo", "dep", "src") for g in (now, old)]
        named = [g._defined.select("repo", F.col("name").alias("dep"), F.col("id").alias("dst")) for g in (now, old)]
        changed = [*self._counted(change, "wanted", DEPENDENCY, *wanted), *self._counted(change, "named", DEPENDENCY, *named)]
        touched = changed[0].select(*DEPENDENCY)
        for c in changed[1:]:
            touched = touched.unionByName(c.select(*DEPENDENCY))
        touched = large(touched.distinct())
        edges = change.lookup("graph_wanted", touched).join(change.lookup("graph_named", touched), DEPENDENCY).select(*DEPENDENCY, "src", "dst")
        change.merge("graph_depends_on", edges, touched, key=DEPENDENCY, unique=[*DEPENDENCY, "src", "dst"])

    def _links(self, change: Transaction, calls_in: DataFrame, calls_out: DataFrame, ends_in: DataFrame, ends_out: DataFrame) -> None:
        calls, ends = change.scan("graph_http_calls"), change.scan("graph_endpoints")
        links = resolve_calls(calls_in, ends).unionByName(resolve_calls(calls, ends_in)).distinct()
        held = change.scan("graph_resolves_to")
        lost = calls_out.select(F.col("id").alias("src"))
        if held is not None:
            lost_ends = held.join(ends_out.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
            lost = held.join(lost, "src", "left_semi").select("src", "dst").unionByName(lost_ends).distinct()
        else:
            lost = lost.withColumn("dst", F.lit(None).cast("string"))
        change.merge("graph_resolves_to", large(links), large(lost), key="src", unique=["src", "dst"], match=["src", "dst"])

    def graph(self, at: Snapshot | None = None) -> SimpleNamespace:
        """The tables as ``operators.graph.Graph`` has them, for the graph's queries."""
        at = at or self.store.snapshot()
        table = lambda name, *columns: unsized(self.store.scan(f"graph_{name}", at).select(*columns))
        edge = ("src", "dst")
        classes = table("classes", "id", "name", "repo", "path", "kind")
        return SimpleNamespace(
            repos=table("repos", "id"), files=table("files", "id", "language", "framework_type"), classes=classes, endpoints=table("endpoints", "id", "method", "path", "repo", "normalized_path"),
            http_calls=table("http_calls", *CALL), belongs_to=table("belongs_to", *edge), defined_in=classes.select(F.col("id").alias("src"), F.col("path").alias("dst")),
            handles=table("handles", *edge), makes=table("makes", *edge), depends_on=table("depends_on", *edge).distinct(), resolves_to=table("resolves_to", *edge, "match_quality", "confidence"),
        )
