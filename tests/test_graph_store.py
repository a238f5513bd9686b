"""A kept graph equals one built anew, whatever changed."""

import random

from quarrymill.operators import graph
from quarrymill.plans.inputs import code_chunks
from quarrymill.sources.graph_store import GraphStore
from quarrymill.sources.store import ChunkStore

TABLES = ("repos", "files", "classes", "endpoints", "http_calls", "belongs_to", "defined_in", "handles", "makes", "depends_on", "resolves_to")
CHUNK = "id string, repo string, path string, language string, framework_type string, text string, classes array<string>, api_routes array<string>, http_calls array<string>, dependencies array<string>"


def tables(g):
    return {n: sorted(str(sorted(r.asDict().items())) for r in getattr(g, n).collect()) for n in TABLES}


def made(rng, k):
    """A chunk over few names, so that facts are shared, lost and found again."""
    name = lambda: rng.choice(["AController", "BService", "C", "Dao"])
    route = lambda: rng.choice(["GET", "POST"]) + " " + rng.choice(["/a", "/a/{id}", "/a/7", "/a/b", "/x/{y}/z", "/x/1/z", "/q"])
    some = lambda f, n: list(dict.fromkeys(f() for _ in range(rng.randint(0, n))))
    return (f"k{k:02}", rng.choice("rs"), rng.choice(["p.java", "q.java"]), rng.choice(["java", "typescript"]), rng.choice([None, "spring-boot"]), rng.choice(["@Service", "@RestController", ""]), some(name, 2), some(route, 2), some(route, 2), some(name, 2))


def test_random_changes_as_a_rebuild(spark, tmp_path):
    rng, now, store = random.Random(11), {}, ChunkStore(spark, str(tmp_path), buckets=2)
    kept = GraphStore(store)
    for step in range(3):
        goes = {k: v for k, v in now.items() if rng.random() < (0.5 if step < 2 else 1)}
        comes = {k: made(rng, k) for k in rng.sample(range(30), 9)} if step < 2 else {}
        goes |= {k: now[k] for k in comes if k in now}
        with store.transaction() as change:
            kept.update(change, spark.createDataFrame(list(goes.values()), CHUNK), spark.createDataFrame(list(comes.values()), CHUNK))
        now = {k: v for k, v in now.items() if k not in goes} | comes
        assert tables(kept.graph()) == tables(graph.build_graph(spark.createDataFrame(list(now.values()), CHUNK))), step
    assert not any(tables(kept.graph()).values())


def test_a_change_touches_its_own_buckets(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), buckets=64)
    chunks = code_chunks(spark, "/root/testdata/sf0.001").cache()
    with store.transaction() as change:
        GraphStore(store).update(change, chunks.limit(0), chunks)
    before, one = store.snapshot().tables, chunks.filter("path = 'src/C12.java'")
    with store.transaction() as change:
        GraphStore(store).update(change, one, one.limit(0))
    after = store.snapshot().tables
    written = {n: sum(before[n].folders.get(b) != after[n].folders.get(b) for b in before[n].folders) for n in after}
    assert max(written.values()) <= 8 and written["graph_classes"] == 1
    assert tables(GraphStore(store).graph()) == tables(graph.build_graph(chunks.filter("path <> 'src/C12.java'")))
