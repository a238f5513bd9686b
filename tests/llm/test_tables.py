import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import ann, components, hilbert, mixing, quotes, range_join
from quarrymill.llm.linking import forest

VECTORS = "vec_id long, embedding array<float>, node string, weight string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "n", "w") for k, v in rows], VECTORS)


ODD = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [None]), (903, [float("nan")] * 8), (904, [float("inf")] * 8)]


def clustered(n, seed=0, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    return [(k, (centres[k % 5] + rng.normal(size=dim) * rng.choice([0.02, 0.4, 2])).astype(np.float32)) for k in range(n)]


# --- vectors ------------------------------------------------------------------------------------


def test_search_finds_nearly_all(spark):
    rows = clustered(300)
    found = ann.search(vectors(spark, rows[::20] + ODD), vectors(spark, rows + ODD), vector_block=100, query_block=6).orderBy("query_id", "rank").collect()
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows], float)
    want = ann.exact_search(x[::20], ids[::20], x, ids)
    got = defaultdict(list)
    for r in found:
        got[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]))
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(ids[::20])
    assert np.mean([len(set(got[q]) & set(w)) / 20 for q, w in zip(ids[::20], want, strict=True)]) >= 0.97


@pytest.mark.parametrize("norms", [(0.01,), (1,), (30,), (0.1, 1, 5)])
def test_margin_follows_the_norms(norms):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32))
    x *= rng.choice(norms, (4000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    ids, q = np.arange(4000), ann.Quantiser.fit(x)
    found = ann.scan_block(q, ids[:40], x[:40], ids, x, q.packed(x).T.copy(), 20).groupby("query_id").vec_id.agg(set)
    want = ann.exact_search(x[:40], ids[:40], x, ids)
    assert np.mean([len(found[k] & set(w)) / 20 for k, w in enumerate(want)]) >= 0.995


def test_search_ties_few_rows_and_none(spark):
    same = [(k, [1.0] * 8) for k in range(5)]
    rows = ann.search(vectors(spark, same[:1]), vectors(spark, same)).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in rows] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert ann.search(vectors(spark, ODD), vectors(spark, ODD)).count() == 0


def plain_links(rows, cosine=0.9):
    ok = [(k, np.asarray(v, float)) for k, v in rows if v is not None and None not in list(v) and np.isfinite(np.asarray(v, float)).all() and np.any(v)]
    links = defaultdict(set)
    for i, (a, x) in enumerate(ok):
        for b, y in ok[:i]:
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, _ in rows:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((k, len(links[k]), min(seen), min(seen) == k))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"cell": 20, "block": 16}])
def test_range_join_is_exact(spark, options):
    rows = [*clustered(240, 3), *((300 + k, v) for k, v in clustered(20, 3)), *ODD]
    assert sorted(map(tuple, range_join.range_join(vectors(spark, rows), **options).collect())) == plain_links(rows)


def test_range_join_of_nothing(spark):
    assert range_join.range_join(vectors(spark, [])).count() == 0
    assert sorted(map(tuple, range_join.range_join(vectors(spark, ODD)).collect())) == [(k, 0, k, True) for k, _ in ODD]


def test_range_join_with_one_id_for_several_vectors(spark):
    rows = [(1, (1, 0)), (1, (0, 1)), (2, (1, 0.01)), (3, (1, 0, 0)), (4, (0, 1))]
    assert sorted(map(tuple, range_join.range_join(vectors(spark, rows)).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 1, False)]


def test_range_join_over_many_cells_near_the_threshold(spark):
    """Vectors with structure, many of whose cosines lie about 0.9, replicated to some of many cells."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + 0.32 * rng.normal(size=16) * np.linalg.norm(centres[k % 40]) / 4).astype(np.float32)) for k in range(800)]
    x = range_join._unit(np.array([v for _, v in rows], float))
    cosines = (x @ x.T)[np.triu_indices(800, 1)]
    assert ((cosines > 0.88) & (cosines < 0.92)).sum() > 1000
    got = sorted(map(tuple, range_join.range_join(vectors(spark, rows), cell=25, block=64).collect()))
    assert got == plain_links(rows) and sum(n for _, n, *_ in got) > 2000


def test_replicas_keep_every_close_pair():
    rng = np.random.default_rng(5)
    x = range_join._unit(rng.normal(size=(300, 3)))
    pivots, r = x[:12], 0.4472136
    d = range_join._distances(x, pivots)
    home, radius = d.argmin(1), np.array([d[d.argmin(1) == c, c].max(initial=-np.inf) for c in range(12)])
    there = range_join.replicas(d, range_join._distances(pivots, pivots), radius, r)
    close = range_join._distances(x, x) <= r
    assert all(there[j, home[i]] for i, j in zip(*np.nonzero(close), strict=True)) and there.mean() < 0.9


def test_components_and_forest(spark):
    random.seed(6)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    want = {}
    for a, b in edges:
        for n in (a, b):
            want.setdefault(n, {n})
        joined = want[a] | want[b]
        for n in joined:
            want[n] = joined
    got = components.connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {n: min(s) for n, s in want.items() if len(s) > 1}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    label = forest(*np.array(edges).T.copy(), 200)
    assert all(label[n] == min(s) for n, s in want.items())


# --- sharding -----------------------------------------------------------------------------------


def test_hilbert_curve_has_no_jumps(spark):
    cells = [(a, b, c) for a in range(4) for b in range(4) for c in range(4)]
    rows = spark.createDataFrame(cells, "a int, b int, c int").select("*", hilbert.hilbert_index(F.array("a", "b", "c"), 3, 2).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(64))
    assert all(abs(x["a"] - y["a"]) + abs(x["b"] - y["b"]) + abs(x["c"] - y["c"]) == 1 for x, y in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 23, 24, 100])
def test_shards_have_equal_counts(spark, n):
    import zlib

    random.seed(n)
    data = [(None if k == 3 else k, random.choice([None, "", "text é", "t" * k]), random.choice(["en", None]), f"s{k % 3}", k, 7) for k in range(n)]
    docs = spark.createDataFrame(data + data[5:6], "doc_id long, text string, lang string, source string, n_chars long, shard long")
    rows = hilbert.shard_documents(docs).collect()
    total = len(data) + len(data[5:6])
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(24)]
    assert len(rows) == total == sum(sizes) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {k: t for k, t, *_ in data}
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows if r["doc_id"] is not None)


def test_shards_prune_in_several_dimensions(spark):
    random.seed(9)
    docs = spark.createDataFrame([(k, "x" * random.randrange(1, 400), random.choice(["de", "en", "es", "fr"]), f"s{random.randrange(9)}") for k in range(2400)], "doc_id long, text string, lang string, source string")
    spans = hilbert.shard_documents(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("shard").agg(F.max("doc_id") - F.min("doc_id"), F.max("size") - F.min("size"), F.countDistinct("source")).collect()
    ids, size, sources = (np.mean([r[k] for r in spans]) for k in (1, 2, 3))
    assert ids < 0.75 * 2400 and size < 0.75 * 400 and sources < 8


# --- mixing -------------------------------------------------------------------------------------


def test_raking_reaches_the_targets():
    rng = np.random.default_rng(2)
    codes = [rng.integers(0, 3, 40), rng.integers(0, 4, 40)]
    goals = [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4])]
    w, sweeps, error = mixing.rake(rng.integers(1, 100, 40).astype(float), codes, goals)
    assert sweeps < mixing.SWEEPS and error < mixing.TOLERANCE
    for code, goal in zip(codes, goals, strict=True):
        assert np.bincount(code, w) == pytest.approx(goal)
    tokens, ratio = rng.integers(1, 100, 40).astype(float), rng.random(40) + 0.1
    for share in (0.1, 0.7, 0.99):
        c = mixing.calibrated(tokens, ratio, share * tokens.sum())
        assert (tokens * np.minimum(1, c * ratio)).sum() == pytest.approx(share * tokens.sum())


def test_mixing_by_both_ways(spark):
    random.seed(4)
    data = [(k, "w " * random.randrange(0, 60), random.choice("aaab"), random.choice(["en", None]), random.choice([None, 1, 2])) for k in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, topic int")
    decided = lambda **options: {r["doc_id"]: r for r in mixing.mixed(docs, mixing.token_count(F.col("text")), **options).select("row.doc_id", "tokens", "probability", "kept").collect()}
    rows = decided()
    assert len(rows) == 3000 and all(r["tokens"] == len((t or "").split()) for (k, t, *_), r in zip(data, rows.values(), strict=False) if rows[k] is r)
    total = sum(r["tokens"] for r in rows.values())
    assert sum(r["tokens"] * r["probability"] for r in rows.values()) == pytest.approx(mixing.BUDGET * total)
    assert abs(sum(r["tokens"] for r in rows.values() if r["kept"]) / total - mixing.BUDGET) < 0.05
    for targets in ({}, {"lang": {"en": 0.3, None: 0.7}}):
        here, by_spark = decided(targets=targets), decided(targets=targets, max_cells=0)
        assert all(by_spark[k]["probability"] == pytest.approx(r["probability"], abs=1e-7) for k, r in here.items())
    none = mixing.mixed(docs.limit(0), mixing.token_count(F.col("text")))
    assert none.count() == 0
    given = mixing.full_target({"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 0.2, "b": 0.2}, 1)
    assert given == pytest.approx({"a": 0.45, "b": 0.45, "c": 0.1})


def plain_mixing(rows, budget, temper):
    """Keep probability of each row by raking and bisection over dicts."""
    cells, probability = defaultdict(float), {}
    for tokens, cell in rows:
        cells[cell] += tokens
    total = sum(cells.values())
    w = {c: t / total for c, t in cells.items() if t}
    goals = []
    for d in range(3):
        raised = defaultdict(float)
        for c, x in w.items():
            raised[c[d]] += x
        raised = {v: x**temper for v, x in raised.items()}
        goals.append({v: x / sum(raised.values()) for v, x in raised.items()})
    for _ in range(200):
        for d in range(3):
            now = defaultdict(float)
            for c, x in w.items():
                now[c[d]] += x
            w = {c: x * goals[d][c[d]] / now[c[d]] for c, x in w.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        probability = {c: min(1, mid * x * total / cells[c]) for c, x in w.items()}
        low, high = (mid, high) if sum(cells[c] * p for c, p in probability.items()) < budget * total else (low, mid)
    return [probability.get(cell, 1.0) for _, cell in rows]


def test_mixing_query_as_brute_force(spark, tmp_path):
    from quarrymill.llm import queries
    from quarrymill.llm.common import uniform

    random.seed(14)
    data = [(k, random.choice([None, "", "a b", "w " * (k % 37)]), random.choice("aaab"), random.choice(["en", "de", None]), 5, 0.5) for k in range(400)]
    spark.createDataFrame(data, "doc_id long, text string, source string, lang string, topic int, probability double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 4) for k in range(0, 400, 3)], "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["doc_id"]: r for r in queries.op4_source_mixing(spark, str(tmp_path)).withColumn("u", uniform(mixing.SEED, F.col("doc_id"))).collect()}
    want = plain_mixing([(len((t or "").split()), (s, lang, k % 4 if k % 3 == 0 else None)) for k, t, s, lang, *_ in data], mixing.BUDGET, mixing.TEMPER)
    assert len(got) == len(data)
    for (k, t, *_), p in zip(data, want, strict=True):
        r = got[k]
        assert r["tokens"] == len((t or "").split()) and r["probability"] == pytest.approx(p, abs=1e-7) and r["kept"] == (r["u"] < r["probability"])


def test_targets_out_of_reach_are_reported(spark):
    docs = spark.createDataFrame([(1, "a", "en", 9), (2, "b", "de", 1)], "doc_id long, source string, lang string, tokens long")
    for cells in (10, 0):
        with pytest.warns(UserWarning, match="miss their targets"):
            made = mixing.probabilities(docs, ("source", "lang"), {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}}, max_cells=cells, sweeps=3)
        assert made.sweeps == 3 and made.error == pytest.approx(0.4)


def test_token_counts(spark):
    texts = [None, "", "  ", "a", " a\tb\n\nc ", "é ü"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.token_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [len((t or "").split()) for t in texts]


# --- quotations ---------------------------------------------------------------------------------

MESSAGES = [
    (1, 0, "user", "Hello there\nHow are  you?"),
    (1, 1, "assistant", "> hello There\n> how are you?\nFine, thanks."),
    (1, 2, "user", ">> Hello there\n> Fine, thanks.\n\nGood to hear\n> never said"),
    (1, 3, "user", None),
    (1, 4, "assistant", "   > Good to hear\nIndeed"),
    (2, 0, "user", "Hello there"),
    (2, 1, "user", "> How are you?"),
    (None, 1, "user", "> x\ny"),
    (3, None, "user", ""),
    (2, 0, "user", "Hello there"),
]


def test_quotes_link_and_order(spark):
    rows = spark.createDataFrame([(*m, "z") for m in MESSAGES], "conv_id long, turn long, role string, text string, body string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.reply_ordered(rows).collect()}
    assert quotes.reply_ordered(rows).count() == len(MESSAGES)
    one = [got[1, k] for k in range(5)]
    assert [r["reply_to"] for r in one] == [None, 0, 1, None, 2]
    assert [(r["thread_root"], r["depth"]) for r in one] == [(0, 0), (0, 1), (0, 2), (3, 0), (0, 3)]
    assert [r["body"] for r in one] == ["Hello there\nHow are  you?", "Fine, thanks.", "Good to hear", "", "Indeed"]
    assert [(r["n_quotes"], r["n_linked"]) for r in one] == [(0, 0), (1, 1), (3, 2), (0, 0), (1, 1)]
    assert [one[k]["position"] for k in (0, 1, 2, 4, 3)] == [0, 1, 2, 3, 4]
    assert got[2, 1]["reply_to"] is None and got[2, 1]["n_quotes"] == 1  # quotes another conversation
    assert got[None, 1]["body"] == "y" and got[None, 1]["reply_to"] is None and got[3, None]["body"] == ""
    assert quotes.reply_ordered(rows.limit(0)).count() == 0


def test_a_passage_needs_half_of_its_lines(spark):
    data = [
        (1, 0, "u", "yes\nalpha one\nbeta two\ngamma three"), (1, 1, "u", "yes"), (1, 2, "u", "> yes\n> something else\n> and more\nno"),
        (1, 3, "u", "> alpha one\n> changed\n> gamma three\nwhy"), (1, 4, "u", "> beta two\n> gamma three\nok"),
    ]
    rows = quotes.reply_ordered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [r["reply_to"] for r in rows] == [None, None, None, 0, 0]


def test_quotes_as_sql(spark):
    """Random conversations of quotes of quotes, with repeats, gaps and nulls."""
    import duckdb
    import pandas as pd

    random.seed(11)
    data = list(MESSAGES)
    for conv in range(10, 30):
        said = []
        for turn in range(random.randint(1, 9)):
            parts = [random.choice(["yes", "No way", "maybe  later", "", "a\nb"])]
            if said and random.random() < 0.7:
                quoted = random.choice(said).split("\n")
                parts.insert(random.randint(0, 1), "\n".join(("> " if random.random() < 0.8 else ">") + x for x in quoted))
            said.append("\n".join(parts))
            data.append((conv, turn, "user", said[-1]))
    columns = ["conv_id", "turn", "role", "text"]
    conversations = pd.DataFrame(data, columns=columns).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.sql(quotes.ORACLE)
    got = quotes.reply_ordered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
