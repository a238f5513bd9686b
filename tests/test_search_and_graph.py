import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrymill.api import Engine, repository_chunks
from quarrymill.operators import evidence, graph, graph_queries, hybrid, keyword, tickets
from quarrymill.operators.chunking import ChunkSizes
from quarrymill.operators.dense import hash_embedding
from quarrymill.sources.files import read_repository
from quarrymill.sources.incremental import file_changes, ingest_counts
from quarrymill.sources.store import ChunkStore

BACKEND = """@RestController
public class UserController {
  private final UserService users;
  @GetMapping("/api/users/{id}")
  public UserResponse one(UserRequest q) { return null; }
}
"""
SERVICE = """@Service
public class UserService {
  private UserRepository repository;
  private TwilioClient sms;
}
"""
FRONTEND = """@Component({ selector: 'u' })
export class UserComponent {
  constructor(private api: UserApiService) {}
  load() { return this.http.get(`/api/users/7`); }
}
"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repos")
    files = {
        "back/src/UserController.java": BACKEND, "back/src/UserService.java": SERVICE, "back/src/UserRepository.java": "@Repository\npublic class UserRepository { private UserService back; }",
        "back/README.md": "# Users\nArchitecture of users.\n\n## Settings\nconfig here", "back/build/skip.java": "class Skipped {}", "front/src/user.ts": FRONTEND, "front/a.py": "def go():\n    return 1\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    ticket = spark.createDataFrame([("T-1", "Fix slow users page", "d", "open", "high", "r", "users", "bug")], "key string, summary string, description string, status string, priority string, reporter string, affected_feature string, ticket_type string")
    return Engine.ingest(spark, {"back": f"{root}/back", "front": f"{root}/front"}, ticket_table=ticket)


def test_ingest_makes_chunks_of_all_supported_files(engine):
    rows = engine.chunks.collect()
    assert {r["path"].rsplit("/", 1)[-1] for r in rows} == {"UserController.java", "UserService.java", "UserRepository.java", "README.md", "user.ts", "a.py"}
    assert len({r["id"] for r in rows}) == len(rows)


def test_graph_trace_and_evidence(engine):
    rows = engine.trace("users").collect()
    assert {tuple(r["service_chain"]) for r in rows} >= {("UserController",), ("UserController", "UserService"), ("UserController", "UserService", "UserRepository")}
    assert rows[0]["frontend_callers"][0]["caller"] == "UserComponent"
    # a cycle of two classes: an edge is used once, a node may come again
    assert max(r["hops"] for r in rows) == 3
    summary = engine.explain("users").first()
    assert (summary["backend_endpoints"], summary["frontend_components"], summary["confidence"], summary["unresolved_hops"]) == (1, 1, 1.0, 0)
    assert evidence.unresolved_hops(engine.trace("users"), "first_row").count() == 2
    assert engine.explain("nothing").first()["confidence"] == 0.0
    found = evidence.api_contracts(evidence.backend_endpoints(engine.trace("users")), evidence.supporting_chunks(engine.chunks, engine.spark.createDataFrame([("UserController",)], "name string"))).first()
    assert (found["request_dto"], found["response_dto"], found["path_params"]) == ("UserResponse", "UserRequest", ["param"])


def test_catalog_scopes_only_callers_files(engine):
    row = engine.endpoints("elsewhere").first()
    assert row["frontend_callers"][0]["caller"] == "UserComponent" and row["frontend_callers"][0]["file"] is None
    assert engine.endpoints("elsewhere", only_repo=True).count() == 0
    assert engine.dependencies("UserController").first()["dependencies"] == ["UserRepository", "UserService", "UserService"]


def test_search_related_sections_and_plan(engine):
    found = engine.search("users architecture settings", limit=3).collect()
    assert len(found) == 3 and found[0]["confidence"] in ("high", "medium", "low")
    assert engine.related(found[0]["id"]).first()["id"] and engine.related("none").count() == 0
    assert "Settings" in engine.explain_section(found[0]["path"], "Settings").first()["summary"]
    assert engine.summarize_repo("back").first()["important_files"]
    plan = engine.plan("t-1")
    assert "## Components" in plan and "reproduce the defect" in plan and "UserComponent" in plan
    with pytest.raises(ValueError):
        engine.plan("T-9")
    for bad in ({"limit": 0}, {"limit": 26}, {"mode": "other"}):
        with pytest.raises(ValueError):
            hybrid.QueryRequest("q", **bad)


def test_keyword_scores_by_a_plain_model(spark):
    texts = ["a b a", "b c", "b d e", "", "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["score"] for r in keyword.keyword_search(keyword.build_index(docs), docs, "a b b zz", 10).collect()}
    tokens = [t.split() for t in texts]
    n = Counter(w for t in tokens for w in set(t))
    raw = {w: math.log(5 - k + 0.5) - math.log(k + 0.5) for w, k in n.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    mean = sum(map(len, tokens)) / 5
    for k, t in enumerate(tokens):
        want = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in ["a", "b", "b", "zz"] if w in t)
        assert got[k] == pytest.approx(want)


def test_hash_embedding_has_unit_length(spark):
    rows = hash_embedding(spark.createDataFrame([(1, "A b a"), (2, " ")], "id long, text string"), dim=16).collect()
    assert {r["id"] for r in rows} == {1} and sum(r["value"] ** 2 for r in rows) == pytest.approx(1)


def test_incremental_and_store(spark, tmp_path):
    now = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], "repo string, path string, signature string")
    past = spark.createDataFrame([("r", "a", "1", 2), ("r", "b", "0", 3), ("r", "d", "4", 4)], "repo string, path string, signature string, n_chunks long")
    got = {r["path"]: (r["status"], r["removed"]) for r in file_changes(now, past).collect()}
    assert got == {"a": ("skipped", 0), "b": ("changed", 3), "c": ("new", 0), "d": ("stale", 4)}
    assert tuple(ingest_counts(file_changes(now, past, force=True)).first()) == (3, 0, 1, 9)
    store = ChunkStore(spark, str(tmp_path))
    store.upsert("c", spark.createDataFrame([("x", 1), ("y", 1)], "id string, v int"))
    store.upsert("c", spark.createDataFrame([("y", 2), ("y", 2)], "id string, v int"))
    store.delete("c", spark.createDataFrame([("x",)], "id string"))
    assert store.collections() == ["c"] and [tuple(r) for r in store.scan("c").collect()] == [("y", 2)] and store.get("c", "y").first()["v"] == 2


def test_stream_writes_what_batch_makes(spark, tmp_path):
    from quarrymill.streaming.ingest import chunk_documents, stream_into

    docs = spark.createDataFrame([("a.md", "# A\none"), ("b.md", "two")], "path string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    store = ChunkStore(spark, str(tmp_path / "store"))
    stream_into(spark, str(tmp_path / "in"), docs.schema, store, "chunks", str(tmp_path / "check")).awaitTermination()
    assert {r["id"] for r in store.scan("chunks").collect()} == {r["id"] for r in chunk_documents(docs).collect()}


def test_keywords_of_tickets(spark):
    rows = spark.createDataFrame([("login", "Fix login after update of sessions sessions page"), (None, "Modify the users table"), (None, None)], "f string, s string")
    assert [r["k"] for r in rows.select(tickets.feature_keywords(F.col("f"), F.col("s")).alias("k")).collect()] == [["login", "sessions"], ["users", "table"], []]


def test_two_repositories_may_share_a_path_and_an_endpoint(spark):
    rows = [("1", "r1", "a.java", "java", "class A {}", ["A"], ["GET /x"]), ("2", "r2", "a.java", "java", "class B {}", ["B"], ["GET /x", "broken"])]
    chunks = spark.createDataFrame(rows, "id string, repo string, path string, language string, text string, classes array<string>, api_routes array<string>")
    none = F.array().cast("array<string>")
    g = graph.build_graph(chunks.withColumns({"framework_type": F.lit(None).cast("string"), "http_calls": none, "dependencies": none}))
    assert g.files.count() == 1 and g.belongs_to.count() == 2
    assert [(r["id"], r["repo"]) for r in g.endpoints.collect()] == [("GET::/x", "r2")] and g.handles.count() == 2
    assert graph_queries.endpoint_catalog(g).first()["frontend_callers"][0]["caller"] is None


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_same_relative_path_in_two_repositories(spark):
    """Each text stays under its own repository, and links stay in the file."""
    sizes = ChunkSizes(1, 3, 1)
    rows = [("a", "README.md", "# One\nx y z\n\nu v w"), ("b", "README.md", "# Two\nq"), ("a", "m.py", "def f():\n    return 1\n"), ("b", "m.py", "def g(x):\n    return x\n"), ("a", "p.html", "<h1>H</h1><p>a</p>"), ("b", "p.html", "<h1>K</h1><p>b</p>")]
    found = repository_chunks(spark.createDataFrame(rows, "repo string, path string, text string"), sizes).collect()
    texts = {(r["repo"], r["path"]): set() for r in found}
    for r in found:
        texts[r["repo"], r["path"]].add(r["text"])
        if r["next_chunk_id"]:
            assert [(n["repo"], n["path"]) for n in found if n["id"] == r["next_chunk_id"]] == [(r["repo"], r["path"])]
    assert texts["b", "README.md"] == {"# Two\nq"} and "# Two\nq" not in texts["a", "README.md"]
    assert texts["a", "m.py"] == {"def f():\n    return 1"} and texts["b", "m.py"] == {"def g(x):\n    return x"}
    assert texts["a", "p.html"] == {"H\na"} and texts["b", "p.html"] == {"K\nb"}


def test_second_ingest_parses_only_what_changed(spark, tmp_path):
    from quarrymill.sources.ingest import Ingestion

    root, store = tmp_path / "repo", str(tmp_path / "store")
    write(root, {"a.md": "# A\nalpha words", "b.md": "# B\nbeta words", "c.py": "def c():\n    return 3\n"})
    jobs = lambda: Ingestion(spark, store).table("jobs").orderBy("started").collect()
    first = Engine.ingest(spark, {"r": str(root)}, store=store)
    assert first.chunks.count() == 3 and [(j["status"], j["parsed"], j["skipped"]) for j in jobs()] == [("completed", 3, 0)]
    write(root, {"a.md": "# A\ngamma words now"})
    (root / "b.md").unlink()
    second = Engine.ingest(spark, {"r": str(root)}, store=store)
    assert tuple(jobs()[-1])[1:7] == ("completed", 1, 1, 1, 2, 1)
    assert {r["text"] for r in second.chunks.collect()} == {"# A\ngamma words now", "def c():\n    return 3"}
    assert {r["term"] for r in second.index.idf.collect()} == {"a", "gamma", "words", "now", "def", "c", "return", "3"}
    assert {r["id"] for r in second.vectors.collect()} == {r["id"] for r in second.chunks.collect()}
    assert second.search("gamma words", limit=1).first()["path"].endswith("a.md")
    with pytest.raises(RuntimeError):
        Ingestion(spark, store).run(read_repository(spark, str(root), "r"), lambda files: (_ for _ in ()).throw(RuntimeError("no parser")), force=True, job_id="bad")
    assert Ingestion(spark, store).job("bad").first()["status"] == "failed" and Ingestion(spark, store).job("none").count() == 0
    assert Engine.ingest(spark, {"r": str(root)}, store=store).chunks.count() == 2 and jobs()[-1]["skipped"] == 2


def test_pdf_files_need_a_reader(spark, tmp_path):
    write(tmp_path, {"a.pdf": b"%PDF-1.4 \xff", "b.md": "x"})
    assert [r["path"][-4:] for r in read_repository(spark, str(tmp_path)).collect()] == ["b.md"]
    files = read_repository(spark, str(tmp_path), "r", pdf_text=lambda raw: f"# Page\n{len(raw)} bytes")
    found = {r["path"][-5:]: r for r in repository_chunks(files).collect()}
    assert (found["a.pdf"]["text"], found["a.pdf"]["language"], found["a.pdf"]["chunk_type"]) == ("# Page\n10 bytes", "pdf", "pdf") and len(found) == 2


def test_report_is_the_evidence_as_text(engine):
    text = engine.report("users")
    assert text == engine.report("users")
    assert "GET /api/users/{id}: UserController (controller) in back" in text and "takes UserResponse, gives UserRequest" in text
    assert "UserComponent" in text and "## Chain\nUserController\n" in text and "## Provenance\n1. " in text
    assert "- none found" in engine.report("nothing")


def test_keyword_index_takes_and_loses_documents(spark):
    docs = spark.createDataFrame(list(enumerate(["a b a", "b c", "b d e", "", "b"])), "id long, text string")
    whole = keyword.build_index(docs)
    plain = lambda index: [sorted(map(tuple, t.collect())) for t in (index.postings, index.lengths, index.idf, index.totals)]
    assert plain(keyword.build_index(docs.filter("id < 2")).with_documents(docs.filter("id >= 1"))) == plain(whole)
    assert plain(whole.without(docs.filter("id = 2").select("id"))) == plain(keyword.build_index(docs.filter("id <> 2")))
    asked = keyword.query_index(docs, "b a zz")
    assert plain(asked)[1:] == plain(whole)[1:] and sorted(map(tuple, asked.postings.collect())) == [(0, "a", 2), (0, "b", 1), (1, "b", 1), (2, "b", 1), (4, "b", 1)]


def test_routes_join_on_literal_segments(spark):
    from quarrymill.functions import routes

    names = ["/a/{param}", "/a/b", "/{param}/b", "/a/{param}/c", "/a/b/c", "/{param}/{param}", "/x/y", "", "/a"]
    rows = spark.createDataFrame([(v, n) for v in ("GET", "PUT") for n in names], "verb string, front string")
    got = {tuple(r) for r in graph.resolve_routes(rows, rows.withColumnRenamed("front", "back")).collect()}
    every = rows.join(rows.withColumnRenamed("front", "back"), "verb").withColumn("q", routes.match_quality(F.col("front"), F.col("back"))).filter("q <> 'none'")
    assert got == {tuple(r) for r in every.select("verb", "front", "back", "q").collect()}


PLAN = """# T-1: Fix slow users page

- ticket_type: bug
- status: open
- priority: high
- feature: users, confidence 1.00

## Description
d

## Components
- GET /api/users/{id} (normally /api/users/{param}) in back: UserController [controller]
  - parameters: param
  - request: UserResponse
  - response: UserRequest

## Chain
- UserController

## Callers
- UserComponent in front src/user.ts calls GET /api/users/{id} (exact, 1.00)

## Files
- [back] src/UserController.java

## Outside boundaries
- none found

## Checklist
- [ ] reproduce the defect through a listed endpoint
- [ ] add a test that fails because of it
- [ ] mend the handler
- [ ] run the tests along the chain
- [ ] extend the integration tests

## Provenance
1. endpoint GET /api/users/{id} handled by UserController
2. caller UserComponent of GET /api/users/{id} by exact 1.0
"""


def test_the_whole_plan_and_the_context_of_a_feature(engine):
    """The text as written out by hand from the four files of the feature."""
    assert engine.plan("T-1") == PLAN
    text = engine.context("users")
    assert text == engine.context("users") and text.startswith("# users\n\nConfidence") and text.count("\n### ") <= 4 and "\n### back src/UserController.java\n" in text
    assert "- none found" in engine.context("nothing")
