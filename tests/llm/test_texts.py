import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrymill.llm import bpe, chosen_path, licenses, lines, shingles, toxicity
from quarrymill.llm.cuckoo import CuckooFilter

PATH = public_tokenizers.path("byte_bpe_50k.json")
EXTRA = "doc_id long, text string, row long, h1 string, score string"


def documents(spark, texts, first=0):
    """Documents with extra columns whose names clash with those used inside operators."""
    return spark.createDataFrame([(k, t, 1, "x", "y") for k, t in enumerate(texts, first)], EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


# --- BPE ----------------------------------------------------------------------------------------


def test_tree_encoding_equals_the_library():
    enc, own = bpe.load(PATH), Tokenizer.from_file(PATH)
    random.seed(5)
    pieces = ["a" * 9, "'s", "'", "!!", " ", "  ", "\n", "é", "日本", "12", "<|endoftext|>", "hello", "🙂", "\t", "'ll", " the"]
    for k in range(400):
        text = "".join(random.choice(pieces) for _ in range(random.randint(0, 90)))
        text = random.choice(["a", "=", "ab", " ", "é"]) * random.randint(1, 300) if k % 7 == 0 else text
        got = bpe.encode_text(enc, text, random.choice([3, 8, 40])).tolist()
        assert got == own.encode(text, add_special_tokens=False).ids
        assert enc.decode_bytes(got).decode() == text


def test_round_trip_of_all_kinds_of_rows(spark):
    texts = [None, "", "short", "x" * 500, "y z " * 300, "y z " * 300, "<|endoftext|> é"]
    own = Tokenizer.from_file(PATH)
    docs = documents(spark, texts)
    encoded = bpe.encode(docs, PATH, leaf=16, spread=100)
    assert encoded.columns == ["row", "ids"] and encoded.select("row.*").columns == ["doc_id", "row", "h1", "score"]
    ids = {r["doc_id"]: r["ids"] for r in encoded.select("row.doc_id", "ids").collect()}
    assert ids == {k: own.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    for r in bpe.round_trip(docs, PATH).collect():
        t = texts[r["doc_id"]] or ""
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() and r["n_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[r["doc_id"]])).encode()).hexdigest()
    assert bpe.round_trip(empty(spark), PATH).count() == 0


# --- lines --------------------------------------------------------------------------------------


def plain_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for k, t in rows:
        for x in (t or "").split("\n"):
            if k is not None and len(key(x)) >= 10:
                holders[key(x)].add(k)
    out = []
    for k, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if k is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == k]
        out.append((k, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LINES = [
    "same line here\nown line one\n\nshort", " SAME line HERE \nsame line here\nother", None, "", "no copies at all", "trailing\n", "a line of é accents\nx", "A line of é accents", "same line here",
]


def test_line_dedup_as_brute_force(spark):
    docs = documents(spark, LINES)
    rows = [(k, t) for k, t in enumerate(LINES)]
    assert sorted(map(tuple, lines.line_dedup(docs).collect()), key=str) == plain_lines(rows)
    odd = docs.union(spark.createDataFrame([(None, "same line here", 1, "x", "y"), (1, "a second text of one\nsame line here", 1, "x", "y")], EXTRA))
    assert sorted(map(tuple, lines.line_dedup(odd).collect()), key=str) == plain_lines([*rows, (None, "same line here"), (1, "a second text of one\nsame line here")])
    assert lines.line_dedup(empty(spark)).count() == 0
    assert lines.without_shared(docs).columns == ["row", "kept", "n_lines", "n_dropped"]
    assert sorted(lines.without_shared(docs).select("row.*").collect()) == sorted(docs.collect())


def test_line_index_is_reversible(spark, tmp_path):
    docs = documents(spark, LINES)
    drops = lambda index: sorted((r["doc_id"], tuple(r["drop"])) for r in index.dropped().collect())
    some = lines.LineIndex.build(docs.filter("doc_id < 4"), shards=2)
    grown = some.insert(docs.filter("doc_id >= 4"))
    assert drops(grown) == drops(lines.LineIndex.build(docs))
    assert drops(grown.remove(docs.filter("doc_id >= 4"))) == drops(some)
    without_first = grown.remove(docs.filter("doc_id = 0"))
    assert drops(without_first) == drops(lines.LineIndex.build(docs.filter("doc_id > 0")))
    grown.save(str(tmp_path))
    assert drops(lines.LineIndex.load(spark, str(tmp_path))) == drops(grown)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**63), 2**63 - 1, 30_000) for _ in range(2))
    made = CuckooFilter.sized(20_000)
    made.insert(a, b)  # more than it was sized for
    assert CuckooFilter.loads(made.dumps()).contains(a, b).all() and made.contains(b, a).mean() < 0.01
    assert made.delete(a[:500], b[:500]) == 500 and made.contains(a[500:], b[500:]).all() and made.contains(a[:500], b[:500]).mean() < 0.05


# --- n-gram Jaccard -----------------------------------------------------------------------------


def plain_sets(texts):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\t\n\v\f\r ]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_join(texts):
    sets, links = plain_sets(texts), defaultdict(set)
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or (both and 9 * both >= 4 * (len(sets[i]) + len(sets[j]))):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return out


def near_copies(groups, size, words=120, edits=3):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(random.randint(0, edits)):
                copy[random.randrange(words)] = word()
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("options", [{}, {"small": 4, "block": 8, "levels": 3}])
def test_chosen_paths_lose_no_link(spark, options):
    passage = " ".join(f"shared{k}" for k in range(60))
    texts = [*near_copies(6, 12), *(f"{passage} {t}" for t in near_copies(20, 1, 80)), None, "", "a b c", "A b  c", "", "one", *near_copies(1, 1) * 5]
    got = sorted(map(tuple, chosen_path.jaccard_join(documents(spark, texts), **options).collect()))
    assert got == plain_join(texts)
    kept = {r["doc_id"] for r in chosen_path.near_unique(documents(spark, texts), **options).collect()}
    assert kept == {x[0] for x in got if x[3]}


def test_chosen_paths_split_deep_buckets_in_few_rounds(spark, monkeypatch):
    """A bucket that fits a task is split to its end there: the same buckets, with no round of jobs for each level."""
    passage = " ".join(f"shared{k}" for k in range(90))
    texts = [*near_copies(2, 15), *(f"{passage} {t}" for t in near_copies(60, 1, 40)), *(f"{passage} some {t}" for t in near_copies(1, 9, 40))]
    runs, rounds = chosen_path.needed_runs(5), []
    sketch, _ = shingles.sketches(texts, runs * shingles.COORDINATES)
    nodes = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sketch)], "node long, sketch binary")
    monkeypatch.setattr(chosen_path, "checkpointed", lambda df, f=chosen_path.checkpointed: rounds.append(1) or f(df))

    def split(**options):
        rounds.clear()
        members, chosen = chosen_path.buckets(nodes, runs, small=4, levels=4, **options)
        made, count = defaultdict(list), len(rounds)
        for r in members.collect():
            made[r["path"], r["n"]].append(r["node"])
        assert sorted(made) == sorted((r["path"], r["n"]) for r in chosen.collect())
        assert all(len(set(x)) == len(x) == n for (_, n), x in made.items())
        return sorted((path, sorted(x)) for (path, _), x in made.items()), count

    got, count = split()
    assert max(len(x) for _, x in got) > 4 and count <= 3
    level_by_level, many = split(whole=0)
    mixed, _ = split(whole=20)
    assert got == level_by_level == mixed and many > 6


def test_chosen_paths_of_no_rows_and_null_ids(spark):
    assert chosen_path.jaccard_join(empty(spark)).count() == 0 == chosen_path.near_unique(empty(spark)).count()
    rows = spark.createDataFrame([(k, "a b c d e f", 1, "x", "y") for k in (None, 4, 4)] + [(None, "g h i j k l", 1, "x", "y")] * 2, EXTRA)
    assert sorted(map(str, chosen_path.jaccard_join(rows).collect())) == sorted(
        map(str, [*[Row(doc_id=4, n_links=2, component_id=4, kept=True)] * 2, Row(doc_id=None, n_links=2, component_id=4, kept=False), *[Row(doc_id=None, n_links=1, component_id=None, kept=True)] * 2])
    )
    kept = chosen_path.near_unique(rows)
    assert kept.columns == rows.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "g h i j k l"), (4, "a b c d e f")]


def test_chosen_paths_with_one_id_for_several_texts(spark):
    """The other text of an id neither hides a link nor gets one."""
    a, near = near_copies(1, 2, 60, 1)
    rows = spark.createDataFrame([(1, a, 1, "x", "y"), (1, "quite another text of one id here", 1, "x", "y"), (2, near + " end", 1, "x", "y")], EXTRA)
    got = sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in chosen_path.jaccard_join(rows).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
    assert sorted(r["text"] for r in chosen_path.near_unique(rows).collect()) == sorted([a, "quite another text of one id here"])


def test_chosen_paths_compare_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "PART_BYTES", 3000)
    texts = near_copies(3, 9, 150)
    sketched = pd.DataFrame({"text": texts, "node": range(len(texts)), "doc_id": range(len(texts)), "h1": 0, "h2": 0, "weight": 1, "block": 0, "leaf": 5, "low": 0, "high": 0, "size": [len(t) for t in texts]})
    sketched["brief"] = [x.tobytes() for x in shingles.sketches(texts, 192)[0].astype(np.uint8)]
    sketched["leaves"] = [np.array([5])] * len(texts)
    parts = chosen_path._candidates(sketched, 0.8).merge(sketched[["node", "text"]], on="node")
    assert parts.across.any() and parts.groupby("part").text.agg(lambda t: t.str.len().sum()).max() <= 4000
    found = pd.concat([chosen_path._compared(part, 0.8) for _, part in parts.groupby("part")])
    links = found[found.kind == 0].groupby("a").n.sum()
    assert [int(links.get(k, 0)) for k in range(len(texts))] == [x[1] for x in plain_join(texts)]


def test_chosen_paths_reach_the_target_recall_at_full_depth():
    """Sets at the threshold, split as often as may be, as many runs as are made for that depth."""
    rng, splits, pairs = np.random.default_rng(3), chosen_path.LEVELS + 1, 6000
    assert [chosen_path.needed_runs(k) for k in (0, 1, splits)] == [1, 4, 12]
    for similarity in (0.80, 0.82, 0.85):
        missed = np.ones(pairs, bool)
        for run in range(chosen_path.needed_runs(splits)):
            pair, agree = np.arange(pairs), rng.random((pairs, shingles.COORDINATES)) < similarity
            path = rng.integers(0, 2**63, pairs).astype(np.uint64) & ~np.uint64(1023) | np.uint64(run)
            for _ in range(splits):
                a = np.zeros((len(pair), shingles.COORDINATES), np.uint16)
                row, left = chosen_path.children(path, a)
                _, right = chosen_path.children(path, np.where(agree[pair], a, a + np.uint16(1)))
                pair, path = pair[row[left == right]], left[left == right]
            missed[pair] = False
        assert missed.mean() <= 2 * (1 - chosen_path.RECALL)


def test_shingle_sets_and_sketches():
    texts = ["A b c d e f", "a  b\tc d e f\n", "a b", "", None, "é ü ö ä ß ñ"]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(s) for s in plain_sets(texts)] and (sets[0] == sets[1]).all()
    a, b = near_copies(1, 2, 400, 30)
    x, y = plain_sets([a, b])
    sketch, some = shingles.sketches([a, b])
    assert some.all() and abs((sketch[0] == sketch[1]).mean() - len(x & y) / len(x | y)) < 0.25


# --- toxicity -----------------------------------------------------------------------------------


def plain_segments(scores):
    """Maximal segments by their definition: repeatedly the best, then what lies left and right."""
    best, at = 0, None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return plain_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]


def test_maximal_segments_as_by_definition():
    random.seed(2)
    for _ in range(300):
        scores = [random.choice([-3, -2, -1, 1, 2, 4]) + random.random() / 100 for _ in range(random.randint(0, 25))]
        got = toxicity.maximal_segments(scores)
        want = plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_toxicity_on_held_out_rows(spark):
    random.seed(3)
    calm = [f"w{k}" for k in range(200)]
    texts, marks = [], []
    for k in range(300):
        words = [random.choice(calm) for _ in range(60)]
        if k % 6 == 0:
            for _ in range(4):
                words.insert(random.randrange(60), random.choice(["nastya", "nastyb", "vile", "foulest"]))
        texts.append(" ".join(words))
        marks.append(int(k % 6 == 0))
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(k, m) for k, m in enumerate(marks)] + [(9999, 1), (3, None)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(rows) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    held = [k for k in range(300) if rows[k]["held_out"]]
    assert sum(rows[k]["predicted"] == marks[k] for k in held) >= 0.95 * len(held)
    assert rows[300]["score"] == rows[301]["score"] < 0.5
    blank = toxicity.score_documents(docs, labels.limit(0)).agg(F.max("score").alias("s"), F.count("*").alias("n")).first()
    assert tuple(blank) == (0.0, 302)
    assert toxicity.score_documents(empty(spark), labels).count() == 0


# --- licenses -----------------------------------------------------------------------------------


def test_patience_alignment():
    a, b = "x the cat sat on the mat y".split(), "the cat lay on the mat".split()
    pairs = licenses.patience_alignment(a, b)
    assert [(a[i], b[j]) for i, j in pairs] == [(w, w) for w in ["the", "cat", "on", "the", "mat"]]
    assert licenses.longest_increasing([3, 1, 2, 9, 4]) == [1, 2, 4]


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    noisy = " ".join(w for k, w in enumerate(mit.split()) if k % 12)
    far = "the of to in with " * 3000
    texts = [f"{far}\n{noisy}\n{far}", "Released under the MIT License. and released under the MIT license.", "released mit " + far + " license under the", None, "", licenses.TEMPLATES["Apache-2.0"]]
    rows = sorted(licenses.scanned(documents(spark, texts)).collect(), key=lambda r: r["doc_id"])
    assert [r["license"] for r in rows] == ["MIT", "MIT-notice", None, None, None, "Apache-2.0"]
    assert 0.85 < rows[0]["coverage"] < 1 and rows[0]["first_word"] >= 15000 and rows[1]["coverage"] == 1.0
    assert set(rows[5]["licenses"].split(",")) == {"Apache-2.0", "Apache-2.0-notice"}
    assert licenses.scanned(empty(spark)).count() == 0


def test_licenses_are_not_named_after_their_neighbours():
    scanner = licenses.Scanner()
    names = lambda text: [x[0] for x in scanner.scan(text)]
    for text, name in (
        ("Licensed under CC BY 4.0.", "CC-BY-4.0-notice"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0-notice"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-notice"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-notice"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1-notice"),
        ("Distributed under the MIT License", "MIT-notice"),
    ):
        assert names(f"some words before. {text} and some after") == [name]
    for name, text in licenses.TEMPLATES.items():
        found, license = names("before " + text + " after"), licenses.FORM.sub("", name)
        assert found[0] == name and {licenses.FORM.sub("", x) for x in found} == {license}, (name, found)
        noisy = " ".join(w for k, w in enumerate(licenses.words_of(text)) if k % 12 != 5)
        assert licenses.FORM.sub("", names(noisy)[0]) == license or len(noisy.split()) < 100, (name, names(noisy))


def test_bound_never_passes_over_a_match():
    scanner = licenses.Scanner({"t": "alpha beta gamma delta the of the"}, 0.8)
    random.seed(1)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "zz"]
    for _ in range(400):
        text = [random.choice(words) for _ in range(random.randint(0, 30))]
        n = 7
        every = [text[a:b] for a in range(len(text)) for b in range(a + 1, min(len(text), a + 2 * n) + 1)]
        best = max((len(licenses.patience_alignment(x, scanner.templates["t"])) for x in every), default=0)
        found = scanner.scan(" ".join(text))
        assert bool(found) == (best >= 0.8 * n)
        assert not found or found[0][1] == best / n


def test_counts_of_features():
    assert Counter(toxicity.features("abcdefg")) == Counter(["ab*", "abc*", "abcd*", "abcde*", "abcdef*", "abcdefg"])
