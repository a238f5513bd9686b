"""Snapshots, bucketed tables, transactions and ingest jobs, with faults before every write."""

import json

import pytest
from pyspark.sql import functions as F

from quarrymill.api import Engine, repository_chunks
from quarrymill.sources import ingest
from quarrymill.sources.files import read_repository
from quarrymill.sources.ingest import Ingestion
from quarrymill.sources.store import BUCKET, ChunkStore, ConcurrentChange, RepeatedKeys, Transaction


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def numbers(spark, n, value=0):
    return spark.range(n).select(F.col("id"), F.lit(value).alias("v"))


def test_a_change_writes_the_buckets_it_touches(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), buckets=8)
    store.upsert("c", numbers(spark, 200))
    before = store.snapshot().tables["c"].folders
    assert len(before) == 8 and len(set(before.values())) == 1
    store.upsert("c", spark.createDataFrame([(7, 1)], "id long, v int"))
    after = store.snapshot().tables["c"].folders
    assert sum(before[b] != after[b] for b in before) == 1
    store.delete("c", spark.createDataFrame([(9,), (10_000,)], "id long"))
    assert rows(store.scan("c")) == [(k, int(k == 7)) for k in sorted(set(range(200)) - {9}, key=lambda k: str((k, int(k == 7))))]
    plan = store.get("c", 7)
    assert rows(plan) == [(7, 1)] and len({f.rsplit("/", 2)[1] for f in plan.inputFiles()}) == 1 and BUCKET in plan.inputFiles()[0]
    assert rows(store.get("c", 9)) == [] and rows(store.get("c", 10_000)) == []
    with pytest.raises(ValueError, match="no collection"):
        store.get("d", 1)
    store.delete("c", numbers(spark, 200))
    assert store.scan("c").count() == 0 and store.collections() == ["c"]


def test_readers_keep_their_snapshot_and_vacuum_keeps_what_is_named(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), buckets=4)
    for v in range(4):
        store.upsert("c", numbers(spark, 50, v))
    past = store.snapshot(2)
    assert {r["v"] for r in store.scan("c", past).collect()} == {1} and {r["v"] for r in store.scan("c").collect()} == {3}
    assert store.vacuum(keep=2) == [] and len(store.vacuum(keep=2, grace_hours=0)) == 2  # young folders stay unless asked for
    assert {r["v"] for r in store.scan("c", store.snapshot(3)).collect()} == {2} and {r["v"] for r in store.scan("c").collect()} == {3}


def test_two_writers_of_one_snapshot(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), buckets=2)
    first, second = store.transaction(), store.transaction()
    first.merge("c", numbers(spark, 3, 1))
    second.merge("c", numbers(spark, 3, 2))
    first.commit()
    with pytest.raises(ConcurrentChange):
        second.commit()
    assert {r["v"] for r in store.scan("c").collect()} == {1} and not [n for n in store._listed("_snapshots") if n.endswith("tmp")]


def test_repeated_keys_stop_a_commit(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), buckets=2)
    store.upsert("c", numbers(spark, 3))
    with pytest.raises(RepeatedKeys, match="1 rows of c repeat id"), store.transaction() as change:
        change.merge("d", numbers(spark, 5))
        change.merge("c", spark.createDataFrame([(9, 1), (9, 2)], "id long, v int"))
    assert store.collections() == ["c"] and rows(store.scan("c")) == [(0, 0), (1, 0), (2, 0)]
    with store.transaction() as change:  # unique by more than the key that deals rows out
        assert change.merge("e", spark.createDataFrame([(9, 1), (9, 2)], "id long, v int"), unique=["id", "v"]) == {"added": 2, "rows": 2, "buckets": 1}
        assert change.merge("e", spark.createDataFrame([(8, 1)], "id long, v int"), spark.createDataFrame([(9,)], "id long"), unique=["id", "v"])["added"] == 1
        assert rows(change.scan("e")) == [(8, 1)] and store.scan("e") is None
    with pytest.raises(ValueError, match="kept by id"), store.transaction() as change:
        change.merge("e", None, numbers(spark, 1), key=["id", "v"])


FILES = {"a.md": "# A\nalpha words", "b.md": "# B\nbeta words", "sub/c.py": "def c():\n    return 3\n"}


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    """The tables of a store that was brought to the second state without a fault."""
    at = tmp_path_factory.mktemp("clean")
    return at, _states(spark, at)


def _states(spark, at, fault=None):
    root = at.parent / "repo_of_tests"
    write(root, FILES)
    Engine.ingest(spark, {"r": str(root)}, store=f"{at}/store")
    write(root, {"a.md": "# A\ngamma words now and then", "d.md": "# D\ndelta"})
    (root / "b.md").unlink()
    if fault is not None:
        with pytest.raises(OSError, match="lost disk"):
            fault(lambda: Ingestion(spark, f"{at}/store").run(read_repository(spark, str(root), "r"), repository_chunks, repos=["r"], job_id="lost"))
    Engine.ingest(spark, {"r": str(root)}, store=f"{at}/store")
    store = ChunkStore(spark, f"{at}/store")
    return {n: rows(store.scan(n).select(*[c for c in store.scan(n).columns if c != "signature"])) for n in store.collections()}


@pytest.mark.parametrize("k", [0, 2, 4, 5])
def test_a_fault_before_any_write_leaves_nothing(spark, tmp_path, monkeypatch, clean, k):
    """Chunks, postings, lengths, vectors and manifest, and the commit itself."""
    real, calls = Transaction.merge, []

    def merge(self, name, *args, **options):
        if len(calls) == k:
            raise OSError("lost disk")
        calls.append(name)
        return real(self, name, *args, **options)

    def fault(run):
        before = ChunkStore(spark, f"{tmp_path}/store").snapshot()
        monkeypatch.setattr(Transaction, "merge", merge)
        if k == 5:
            monkeypatch.setattr(Transaction, "commit", lambda self: (_ for _ in ()).throw(OSError("lost disk")))
        try:
            run()
        finally:
            monkeypatch.undo()
            assert ChunkStore(spark, f"{tmp_path}/store").snapshot() == before
            job = Ingestion(spark, f"{tmp_path}/store").job("lost").first()
            assert job["status"] == "failed" and job["errors"] == ["lost disk"]

    found = _states(spark, tmp_path, fault)
    places = lambda t: str(t).replace(str(tmp_path), "").replace(str(clean[0]), "")
    assert set(found) == {"chunks", "postings", "lengths", "vectors", "manifest"}
    for name in found:
        assert len(found[name]) == len(clean[1][name]) and len(found[name]) > 2
    assert {r[2] for r in found["manifest"]} == {1} and sorted(places(r[1]) for r in found["manifest"]) == sorted(places(r[1]) for r in clean[1]["manifest"])
    ids = {x for r in found["manifest"] for x in r[-1]}
    for name in ("chunks", "postings", "lengths", "vectors"):
        assert {r[0] for r in found[name]} == ids


def test_repositories_are_ingested_each_for_itself(spark, tmp_path):
    for repo in "ab":
        write(tmp_path / repo, {"same.md": f"# Same\nof {repo}", "x/only.md": "# Same\nin both"})
    store = f"{tmp_path}/store"
    Engine.ingest(spark, {"a": f"{tmp_path}/a"}, store=store)
    engine = Engine.ingest(spark, {"b": f"{tmp_path}/b"}, store=store)
    assert rows(engine.chunks.select("repo", "path")) == [("a", "same.md"), ("a", "x/only.md"), ("b", "same.md"), ("b", "x/only.md")]
    before = ChunkStore(spark, store).snapshot()
    assert Engine.ingest(spark, {"a": f"{tmp_path}/a"}, store=store).chunks.count() == 4
    jobs = Ingestion(spark, store).table("jobs").orderBy("started").collect()
    assert [(j["parsed"], j["skipped"], j["stale"], j["removed"]) for j in jobs] == [(2, 0, 0, 0), (2, 0, 0, 0), (0, 2, 0, 0)]
    assert ChunkStore(spark, store).snapshot().tables == before.tables  # nothing is written where nothing changed
    for f in (tmp_path / "a").rglob("*.md"):
        f.unlink()
    Ingestion(spark, store).run(read_repository(spark, f"{tmp_path}/b", "a").limit(0), repository_chunks, repos=["a"])
    assert rows(ChunkStore(spark, store).scan("chunks").select("repo", "path")) == [("b", "same.md"), ("b", "x/only.md")]


def test_one_changed_file_rewrites_its_buckets_only(spark, tmp_path):
    write(tmp_path / "r", {f"d{k}.md": f"# T{k}\nwords of {k}" for k in range(40)})
    kept = Ingestion(spark, f"{tmp_path}/store", buckets=64)
    run = lambda: kept.run(read_repository(spark, f"{tmp_path}/r", "r"), repository_chunks, repos=["r"])
    run()
    before = kept.store.snapshot().tables
    write(tmp_path / "r", {"d3.md": "# T3\nother words"})
    run()
    after = kept.store.snapshot().tables
    changed = {n: sum(before[n].folders.get(b) != after[n].folders.get(b) for b in {*before[n].folders, *after[n].folders}) for n in after}
    assert changed["manifest"] == 1 and all(1 <= changed[n] <= 2 for n in ("chunks", "postings", "lengths", "vectors"))


def test_a_job_can_be_read_while_it_runs(spark, tmp_path, monkeypatch):
    write(tmp_path / "r", {f"d{k}.md": f"# T{k}\nwords" for k in range(12)})
    kept, seen = Ingestion(spark, f"{tmp_path}/store", batch_files=5), []
    made = lambda files: seen.append(kept.job("j").first().asDict()) or repository_chunks(files)
    kept.run(read_repository(spark, f"{tmp_path}/r", "r"), made, job_id="j", repos=["r"])
    assert [(j["status"], j["files"], j["parsed"]) for j in seen] == [("running", 12, 12)] * 3
    assert [j["done"] for j in seen] == sorted(j["done"] for j in seen) and seen[0]["done"] == 0 < seen[1]["done"] == seen[1]["chunks"] < 12
    last = kept.job("j").first()
    assert (last["status"], last["done"], last["chunks"]) == ("completed", 12, 12) and last["updated"] >= last["started"]


def test_chunks_know_their_place_below_the_root(spark, tmp_path):
    """Paths below the root, flags of the whole path, the first titles; ids are named by the whole path."""
    write(tmp_path / "r", {"README.md": "# One\na\n\n## Two\nb", "env/x.md": "plain"})
    files = read_repository(spark, f"{tmp_path}/r", "r")
    found = {(r["path"], r["section"]): r for r in repository_chunks(files).collect()}
    assert {p for p, _ in found} == {"README.md", "env/x.md"}
    one = found["README.md", "One"]
    assert one["is_readme"] and one["related_sections"] == ["One", "Two"] and one["origin_path"] == f"{tmp_path}/r/README.md" and not found[next(k for k in found if k[0] == "env/x.md")]["is_readme"]
    assert found[next(k for k in found if k[0] == "env/x.md")]["is_config_doc"]
    assert {r["id"] for r in found.values()} == {r["id"] for r in repository_chunks(files.drop("root")).collect()}
    assert json.dumps(one["heading_hierarchy"]) == '["One"]' and ingest.KEYS == ("repo", "path")


def test_files_that_arrive_again_or_go(spark, tmp_path):
    """A stream of arrivals: new text replaces old chunks, a null text deletes, and a repeated batch changes nothing."""
    from quarrymill.streaming.ingest import apply_batch, stream_into

    store, schema = ChunkStore(spark, f"{tmp_path}/store", buckets=2), "path string, text string, version long"
    arrive = lambda *batch: spark.createDataFrame(batch, schema)
    texts = lambda: sorted((r["path"], r["text"]) for r in store.scan("c").collect())
    arrive(("a", "# A\none", 1), ("b", "# B\ntwo", 1), ("b", "# B\nolder", 0)).write.parquet(f"{tmp_path}/in", mode="append")
    stream_into(spark, f"{tmp_path}/in", schema, store, "c", f"{tmp_path}/check").awaitTermination()
    assert texts() == [("a", "# A\none"), ("b", "# B\ntwo")]
    again = arrive(("a", "# A\nother", 2), ("b", None, 2), ("z", None, 2))
    again.write.parquet(f"{tmp_path}/in", mode="append")
    stream_into(spark, f"{tmp_path}/in", schema, store, "c", f"{tmp_path}/check").awaitTermination()
    assert texts() == [("a", "# A\nother")] and {r["path"] for r in store.scan("c_files").collect()} == {"a"}
    apply_batch(store, "c", again)
    assert texts() == [("a", "# A\nother")]
