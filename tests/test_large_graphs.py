"""Joins of the graph do not trust estimates: a table of any size must not go through the driver."""

import pytest

from quarrymill.operators import graph, graph_queries
from quarrymill.plans.inputs import FEATURE, code_chunks
from quarrymill.plans.queries import edges_of
from quarrymill.sources.graph_store import GraphStore
from quarrymill.sources.store import ChunkStore

DATA = "/root/testdata/sf0.001"


def planned(df):
    """The plan before anything ran; adaptive plans may still broadcast what turns out to be small."""
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def built(spark):
    return graph.build_graph(code_chunks(spark, DATA))


def test_graph_edges_broadcast_nothing_by_estimate(built):
    links = graph.resolve_calls(built.http_calls, built.endpoints)
    assert "Join" in planned(links) and "Broadcast" not in planned(links)
    wanted = built._wanted.join(built.classes.select("repo", built.classes["name"].alias("dep")), ["repo", "dep"])
    assert "Join" in planned(wanted) and "Broadcast" not in planned(wanted)
    assert "Broadcast" not in planned(edges_of(built))


@pytest.mark.parametrize("repo", [None, "beta"])
def test_endpoint_catalog_broadcasts_nothing_by_estimate(built, repo):
    plan = planned(graph_queries.endpoint_catalog(built, repo))
    assert "Join" in plan and "Broadcast" not in plan


def test_graph_stats_are_counts_of_tables_without_estimates(built):
    for table in (built.repos, built.files, built.classes, built.endpoints, built.http_calls, built.resolves_to):
        assert "Broadcast" not in planned(table.join(table.select("src" if "src" in table.columns else "id"), table.columns[0]))


def test_traces_broadcast_nothing_by_estimate(built):
    traces = graph_queries.trace(built, FEATURE)
    paths = graph_queries.bounded_paths(built.classes.select("id"), built.depends_on, 1)
    for joined in (paths.join(built.classes, paths["node"] == built.classes["id"]), traces.join(traces.select("path"), "path")):
        assert "Join" in planned(joined) and "Broadcast" not in planned(joined)


def test_kept_graph_broadcasts_nothing_by_estimate(spark, tmp_path):
    store, chunks = ChunkStore(spark, str(tmp_path), buckets=2), code_chunks(spark, DATA).filter("id < '000000000020'")
    with store.transaction() as change:
        GraphStore(store).update(change, chunks.limit(0), chunks)
        held = change.lookup("graph_makes", change.scan("graph_makes"))
        assert "Broadcast" not in planned(held.select("src").join(held, "src"))
        ends = change.scan("graph_endpoints")
        assert "Broadcast" not in planned(ends.select("path").join(ends, "path"))
    kept = GraphStore(store).graph()
    plan = planned(graph_queries.endpoint_catalog(kept))
    assert "Join" in plan and "Broadcast" not in plan
