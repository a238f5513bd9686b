"""Queries over the graph: endpoint catalogue, bounded paths, traces and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.graph import Graph
from quarrymill.session import large

MOST_HOPS = 5


def bounded_paths(starts: DataFrame, edges: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """All paths (start, node, nodes, hops) of 0 to ``hops`` edges from the ``id``s of ``starts``.

    A path may meet a node again but uses no edge twice.  One join for each hop, all on the
    edge's source, and each level is materialised, so no hop is computed again for the next.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next"))
    level = starts.select(
        F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("nodes"), F.array().cast("array<struct<src:string,dst:string>>").alias("used")
    )
    out = level.withColumn("hops", F.lit(0))
    for k in range(1, hops + 1):
        edge = F.struct(F.col("node").cast("string").alias("src"), F.col("_next").cast("string").alias("dst"))
        level = large(
            level.join(step, "node")
            .filter(~F.array_contains("used", edge))
            .select("start", F.col("_next").alias("node"), F.array_append("nodes", F.col("_next")).alias("nodes"), F.array_append("used", edge).alias("used"))
        )
        out = out.unionByName(level.withColumn("hops", F.lit(k)))
    return out.drop("used")


def _homes(graph: Graph) -> DataFrame:
    """(class_id, file, file_repo): a row for each repository of a class's file."""
    files = graph.defined_in.select(F.col("src").alias("class_id"), F.col("dst").alias("file"))
    return files.join(graph.belongs_to.select(F.col("src").alias("file"), F.col("dst").alias("file_repo")), "file").select("class_id", "file", "file_repo")


def _callers(graph: Graph) -> DataFrame:
    """(endpoint_id, caller_id, caller) of calls that resolve to an endpoint."""
    calls = graph.makes.select(F.col("src").alias("caller_id"), F.col("dst").alias("call"))
    linked = calls.join(graph.resolves_to.select(F.col("src").alias("call"), F.col("dst").alias("endpoint_id")), "call")
    return linked.join(graph.classes.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), "caller_id").select("endpoint_id", "caller_id", "caller").distinct()


def endpoint_catalog(graph: Graph, repo: str | None = None, only_repo: bool = False) -> DataFrame:
    """Every endpoint with the distinct maps of its handlers and callers.

    With ``repo`` alone the condition stands on the optional match of the callers' files and
    only empties those; ``only_repo`` filters the endpoints themselves.  Lists are sorted and
    hold one map of nulls where nothing matched.
    """
    handler = (
        graph.handles.select(F.col("src").alias("class_id"), F.col("dst").alias("endpoint_id"))
        .join(graph.classes.select(F.col("id").alias("class_id"), "name", "kind"), "class_id")
        .join(_homes(graph), "class_id")
        .select("endpoint_id", "name", "kind", "file", F.col("file_repo").alias("repo"))
    )
    ends = graph.endpoints.select(F.col("id").alias("endpoint_id"), "method", "path", F.col("repo").alias("endpoint_repo"))
    if repo and only_repo:
        ends = ends.filter(F.col("endpoint_repo") == repo)
    rows = ends.join(handler, "endpoint_id", "left").join(_callers(graph), "endpoint_id", "left")
    homes = _homes(graph).select(F.col("class_id").alias("caller_id"), F.col("file").alias("caller_file"), F.col("file_repo").alias("caller_repo"))
    if repo:
        asked = F.coalesce((F.col("endpoint_repo") == repo) | (F.col("repo") == repo), F.lit(False))
        rows = rows.withColumn("_where", F.when(asked, F.col("caller_id"))).join(homes.withColumnRenamed("caller_id", "_where"), "_where", "left")
    else:
        rows = rows.join(homes, "caller_id", "left")
    return rows.groupBy("method", "path", "endpoint_repo").agg(
        F.array_sort(F.collect_set(F.struct("name", "kind", "file", "repo"))).alias("handlers"),
        F.array_sort(F.collect_set(F.struct("caller", F.col("caller_file").alias("file"), F.col("caller_repo").alias("repo")))).alias("frontend_callers"),
    )


def trace(graph: Graph, feature: str, hops: int = MOST_HOPS) -> DataFrame:
    """A row (materialised) for each dependency path of each endpoint whose path contains ``feature``.

    Columns: method, path, handler_class, handler_kind, backend_file, backend_repo,
    service_chain, hops and frontend_callers.
    """
    ends = graph.endpoints.filter(F.contains(F.lower("path"), F.lit(feature.lower()))).select(F.col("id").alias("endpoint_id"), "method", "path")
    handles = graph.handles.select(F.col("src").alias("class_id"), F.col("dst").alias("endpoint_id")).join(ends.select("endpoint_id"), "endpoint_id", "left_semi")
    paths = bounded_paths(handles.select(F.col("class_id").alias("id")).distinct(), graph.depends_on, hops)
    names = graph.classes.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    placed = paths.select("start", "nodes", "hops", F.posexplode("nodes").alias("_at", "_id")).join(names, "_id", "left")
    chains = placed.groupBy("start", "nodes", "hops").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_name"))), lambda s: s["_name"]).alias("service_chain"))
    handlers = (
        handles.join(graph.classes.select(F.col("id").alias("class_id"), F.col("name").alias("handler_class"), F.col("kind").alias("handler_kind")), "class_id")
        .join(chains.withColumnRenamed("start", "class_id"), "class_id")
        .join(_homes(graph), "class_id", "left")
    )
    homes = _homes(graph).select(F.col("class_id").alias("caller_id"), F.col("file").alias("caller_file"), F.col("file_repo").alias("caller_repo"))
    callers = _callers(graph).join(homes, "caller_id", "left")
    rows = ends.join(handlers, "endpoint_id", "left").join(callers, "endpoint_id", "left")
    return large(rows.groupBy(
        "method", "path", "handler_class", "handler_kind", F.col("file").alias("backend_file"), F.col("file_repo").alias("backend_repo"), "service_chain", "hops"
    ).agg(F.array_sort(F.collect_set(F.struct("caller", F.col("caller_file").alias("file"), F.col("caller_repo").alias("repo")))).alias("frontend_callers")))


def dependencies_of(graph: Graph, name: str, repo: str | None = None, hops: int = MOST_HOPS) -> DataFrame:
    """(source, repo, dependencies): the name at the end of every path of 1 to ``hops`` edges."""
    starts = graph.classes.filter(F.col("name") == name)
    if repo:
        starts = starts.filter(F.col("repo") == repo)
    paths = bounded_paths(starts.select("id"), graph.depends_on, hops).filter("hops > 0")
    ends = paths.join(graph.classes.select(F.col("id").alias("node"), F.col("name").alias("dependency")), "node")
    named = ends.join(starts.select(F.col("id").alias("start"), F.col("name").alias("source"), "repo"), "start")
    return named.groupBy("source", "repo").agg(F.array_sort(F.collect_list("dependency")).alias("dependencies"))
