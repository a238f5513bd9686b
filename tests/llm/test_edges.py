"""Clashing column names, nulls, empty tables and repeated rows, for every operator and pipeline stage."""


import zlib

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import ann, chosen_path, hilbert, licenses, mixing, queries, range_join, toxicity

#: Names that operators use for columns of their own.
NAMES = sorted(
    set(
        "row drop drop_id drop_row text_row kept n_lines n_dropped id h1 h2 low high leaf leaves block blocks other place part label chunk across weight size some sketch brief node component "
        "component_id n_links repeated rows first again cell raked tokens probability topic reply_to key ids none decoded n_tokens token_ids dim0 hilbert stretch at before shard slot "
        "runs body _lines _levels _starts message score predicted passages toxic feature qb vb codes rank query_id pos line shards bundle n path own".split()
    )
)
BASE = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=BASE, keys=("doc_id",)):
    """Rows with every clashing name as a further string column that tells the row apart."""
    taken = {x.split()[0] for x in schema.split(", ")}
    docs = spark.createDataFrame(rows, schema)
    mark = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return docs.withColumns({n: F.concat(F.lit(f"{n}:"), mark) for n in NAMES if n not in taken})


def plain(rows):
    return sorted(str(sorted(r.asDict(recursive=True).items(), key=str)) for r in rows)


SHARED = "one line that several documents share between them"
ROWS = [
    (1, f"{SHARED}\nown words of the first text go here and on", "en", "a", 80), (2, f"{SHARED}\nown words of the second", "de", "b", 70), (3, None, None, None, None), (4, "", "en", "a", 0),
    (5, "released under the mit license", "fr", "c", 30), (5, "released under the mit license", "fr", "c", 30), (None, "no id at all in this row of words", "en", None, 33), (7, "x" * 40000 + " end", "en", "a", 40004),
]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    """A data folder whose tables have the clashing columns too."""
    at = str(tmp_path_factory.mktemp("edges"))
    docs.write.parquet(f"{at}/documents.parquet")
    table(spark, [(k, int(k % 2), int(k % 3 == 0)) for k in range(1, 9)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    table(spark, [(k, [float(k), 1.0], k % 3) for k in range(1, 8)] + [(None, [1.0, 2.0], 1), (8, None, None), (2, [2.0, 1.0], 2)], "vec_id long, embedding array<float>, label int", ("vec_id",)).write.parquet(f"{at}/embeddings.parquet")
    table(spark, [(1, 0, "user", "hello there"), (1, 1, "user", "> hello there\nyes"), (None, None, None, None)], "conv_id long, turn long, role string, text string", ("conv_id", "turn")).write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_with_clashing_columns(spark, folder, name):
    """The same rows as from tables without the further columns."""
    got = queries.queries()[name](spark, folder)
    bare = f"{folder}/bare"
    if not spark._jvm.java.io.File(f"{bare}/conversations.parquet").exists():
        own = {"documents": BASE, "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, label int", "conversations": "conv_id long, turn long, role string, text string"}
        for t, schema in own.items():
            spark.read.parquet(f"{folder}/{t}.parquet").select(*[x.split()[0] for x in schema.split(", ")]).write.mode("overwrite").parquet(f"{bare}/{t}.parquet")
    want = queries.queries()[name](spark, bare)
    assert got.columns == want.columns and plain(got.collect()) == plain(want.collect())


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_the_columns_they_get(spark, folder, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    found = stage(spark, docs, folder)
    if k + 1 == len(corpus_pipeline.STAGES):
        assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "ids", "decoded_sha256"] or set(found.columns) == {"doc_id", "n_tokens", "ids_sha256", "ids", "decoded_sha256"}
        assert found.count() == len(ROWS)
        return
    assert found.columns == docs.columns
    rows = found.collect()
    free = [c for c in docs.columns if name != "line dedup" or c not in ("text", "n_chars")]
    assert set(plain(found.select(*free).collect())) <= set(plain(docs.select(*free).collect()))
    assert len(rows) == len(ROWS) or name != "line dedup"


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_of_an_empty_table(spark, folder, docs, k):
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), folder).count() == 0


def test_near_copies_leave_one_row_of_each_group(spark, docs):
    """Repeated rows, equal texts under several ids, null ids and empty texts."""
    kept = chosen_path.near_unique(docs)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 7]


def test_the_pipeline_as_brute_force(spark, tmp_path):
    """Kept ids and texts of each stage on planted rows, and the rows of the whole pipeline."""
    import random

    from tokenizers import Tokenizer

    random.seed(21)
    calm = [f"w{k}" for k in range(300)]
    texts, marks = {}, {}
    for k in range(240):
        words = random.choices(calm, k=60)
        if k % 6 == 0:
            for _ in range(6):
                words.insert(random.randrange(60), random.choice(["vileone", "viletwo", "vilesix"]))
        texts[k], marks[k] = " ".join(words), int(k % 6 == 0)
    passage = " ".join(f"shared{k}" for k in range(20))
    for k in (31, 32, 35):
        texts[k] += f"\n{passage}"
    for k in (200, 201):  # near copies of a clean document and exact ones of another
        texts[k], texts[k + 2] = texts[100 + k % 2 * 1] + " end", texts[104 + k % 2 * 1]
        marks[k], marks[k + 2] = 0, 0
    documents = [(k, t, "en", "ab"[k % 2], len(t)) for k, t in texts.items()]
    spark.createDataFrame(documents, BASE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(marks.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(240)], "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sf, now, kept = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(texts)
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf).cache()
        found = {r["doc_id"]: r["text"] for r in now.collect()}
        if name == "toxicity":
            kept = {k: t for k, t in kept.items() if not marks[k]}
        elif name == "line dedup":
            first = {}
            for k in sorted(kept, reverse=True):
                first |= {x.strip().lower(): k for x in kept[k].split("\n") if len(x.strip()) >= 10}
            kept = {k: "\n".join(x for x in t.split("\n") if first.get(x.strip().lower(), k) == k) for k, t in kept.items()}
            assert kept[202] == kept[203] == "" and passage not in kept[32]
        elif name == "n-gram Jaccard join":
            sets = {k: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for k, t in kept.items()}
            group = {k: k for k in kept}
            for a in kept:
                for b in kept:
                    both = len(sets[a] & sets[b])
                    if a < b and (kept[a] == kept[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                        group = {k: min(group[a], group[b]) if g in (group[a], group[b]) else g for k, g in group.items()}
            kept = {k: t for k, t in kept.items() if group[k] == k}
            assert len(group) - len(kept) == 3
        else:
            decided = mixing.mixed(mixing.with_topics(before, spark.read.parquet(f"{tmp_path}/embeddings.parquet")), mixing.token_count(F.col("row.text")), {"source": F.col("row.source"), "lang": F.col("row.lang"), "topic": F.col("topic")})
            chosen = {r["doc_id"] for r in decided.filter("kept").select("row.row.doc_id").collect()}
            assert 0.6 * len(kept) < len(chosen) < len(kept)
            kept = {k: t for k, t in kept.items() if k in chosen}
        assert found == kept, name
        before = now
    own = Tokenizer.from_file(queries.vocabulary())
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {k: own.encode(t, add_special_tokens=False).ids for k, t in kept.items()}


# --- whole queries against plain versions --------------------------------------------------------


def plain_hilbert(point, bits):
    """Index on the Hilbert curve of a point, bit by bit (Skilling's transform on a list)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def test_sharding_query_as_brute_force(spark, tmp_path):
    import math
    import random

    random.seed(31)
    data = [(None if k == 9 else k, random.choice([None, "x" * random.randrange(1, 500)]), random.choice(["en", "de", None]), random.choice([f"https://site.{c}/path" for c in "abcdefgh"]), 1) for k in range(500)]
    spark.createDataFrame(data, BASE).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op8_hilbert_sharding(spark, str(tmp_path)).select("shard", "slot", F.coalesce("doc_id", F.lit(-1)), "hilbert").collect())
    sizes = lambda t: len((t or "").encode()) + 8
    bits = hilbert.BITS

    def numeric(values):
        known = sorted(v for v in values if v is not None)
        cuts = [known[math.ceil(k / 32 * len(known)) - 1] for k in range(1, 32)]
        return lambda v: 0 if v is None else sum(c <= v for c in cuts)

    def textual(values):
        known = sorted(v for v in values if v is not None)
        cuts = [known[math.ceil(k / 32 * len(known)) - 1] for k in range(1, 32)]
        return lambda v: 0 if v is None else sum(c <= v for c in cuts)

    dims = [textual([r[3] for r in data]), textual([r[2] for r in data]), numeric([sizes(r[1]) for r in data]), numeric([r[0] for r in data])]
    index = lambda r: plain_hilbert([d(v) for d, v in zip(dims, (r[3], r[2], sizes(r[1]), r[0]), strict=True)], bits)
    order = sorted(data, key=lambda r: (index(r), zlib.crc32((r[1] or "").encode()), -1 if r[0] is None else r[0]))
    each, more = divmod(len(data), 24)
    want, at = [], 0
    for shard in range(24):
        for slot in range(each + (shard < more)):
            want.append((shard, slot, -1 if order[at][0] is None else order[at][0], index(order[at])))
            at += 1
    assert got == want
    assert len({dims[0](r[3]) for r in data}) == 8  # values that begin alike stay apart
    assert max(dims[1](r[2]) for r in data) == 31  # few values spread over the range


def test_toxicity_query_as_brute_force(spark, tmp_path):
    """Scores by dictionaries and segments by their definition, the curve taken from the model."""
    import math
    import random

    from tests.llm.test_texts import plain_segments

    random.seed(41)
    calm, words = [f"w{k}" for k in range(60)], {}
    for k in range(150):
        words[k] = random.choices(calm, k=25) + (random.choices(["vileone", "viletwo"], k=3) if k % 5 == 0 else [])
    docs = spark.createDataFrame([(k, " ".join(w).upper(), "en", "s", 1) for k, w in words.items()], BASE)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in words], "doc_id long, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op7_toxic_passages(spark, str(tmp_path)).collect()}
    held = {k for k in words if zlib.crc32(str(k).encode()) % 5 == 0}
    learned = [k for k in words if k not in held]
    forms = lambda w: [w[:n] + "*" for n in toxicity.BEGINNINGS if len(w) > n] + [w]
    count = {}
    for k in learned:
        for f in {f for w in words[k] for f in forms(w)}:
            count.setdefault(f, [0, 0])[k % 5 == 0] += 1
    root = sum(k % 5 == 0 for k in learned) / len(learned)

    def ratio(w):
        share = root
        for f in forms(w):
            if sum(count.get(f, [0, 0])) >= toxicity.LEAST_DOCS:
                b, a = count[f]
                share = (a + toxicity.PRIOR * share) / (a + b + toxicity.PRIOR)
        return math.log(share / (1 - share)) - math.log(root / (1 - root)) - toxicity.DRIFT

    model = toxicity.fit(docs, labels)
    for k, own in words.items():
        sums = [model.rate * s for *_, s in plain_segments([ratio(w) for w in own])]
        floor = math.log(toxicity.START_RATE * len(own) + 1)
        x = [max(sums, default=0), math.log1p(sum(s - floor for s in sums if s > floor)), math.log(len(own)), 1]
        assert got[k]["score"] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(model.curve, x, strict=True)))), abs=1e-9)
        assert got[k]["n_passages"] == sum(s > floor for s in sums) and got[k]["held_out"] == (k in held)
    assert all(got[k]["predicted"] == int(k % 5 == 0) for k in held)


def test_license_windows_as_brute_force():
    """No stretch of a text aligns with the template better than what the scan reports, over all stretches."""
    import random

    scanner = licenses.Scanner({"t": "alpha beta gamma delta the of the"}, 0.8)
    template, n = scanner.templates["t"], 7
    random.seed(5)
    for _ in range(150):
        noise = random.choices(["zz", "yy", "the", "of"], k=random.randint(0, 30))
        at = random.randint(0, len(noise))
        planted = [w for w in template if random.random() < 0.9]
        text = noise[:at] + planted + noise[at:]
        found = scanner.scan(" ".join(text))
        every = (len(licenses.patience_alignment(text[a:b], template)) for a in range(len(text)) for b in range(a + 1, min(len(text), a + 2 * n) + 1))
        if len(planted) == n:
            assert found and found[0][1] == 1.0
        if found:
            assert max(every) >= round(found[0][1] * n) >= 0.8 * n


def test_ragged_vectors_take_no_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0]), (20, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(rows, rows).orderBy("query_id").collect()] == [(1, 2), (2, 1)]
    assert sorted((r["vec_id"], r["n_links"]) for r in range_join.range_join(rows).collect()) == [(1, 1), (2, 1), (3, 0), (20, 0)]


def test_no_operator_changes_the_session(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert licenses.scanned(docs).count() == len(ROWS) and chosen_path.jaccard_join(docs).count() == len(ROWS)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
