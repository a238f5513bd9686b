"""Blocks written of documents alone give what plain keyword search gives."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import blockmax, keyword


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    texts = [None, "", "...", *(" ".join(["All"] * rng.randint(0, 3) + rng.choices(["a", "b", "c", "d"], k=rng.randint(0, 9)) + (["rare"] * rng.randint(1, 4) if 300 <= k < 310 else [])) for k in range(497))]
    docs = spark.createDataFrame([(f"k{k:03}", t, "xyz"[k % 3]) for k, t in enumerate(texts)], "id string, text string, kind string").repartition(3, "id").cache()
    return docs, blockmax.written_blocks(docs, size=16)


def test_the_index_is_that_of_the_documents(corpus):
    docs, built = corpus
    want = keyword.build_index(docs)
    for name in ("postings", "lengths", "idf", "totals"):
        one, other = (getattr(x, name) for x in (built.index, want))
        rows = lambda t: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.select(*other.columns).collect())  # noqa: B023, E731
        assert rows(one) == rows(other), name
    heads = built.blocks.agg(F.max("n").alias("n"), F.sum("n").alias("all")).first()
    assert heads["n"] <= 16 and heads["all"] == want.postings.count()
    assert not [c for c in built.blocks.columns if c in ("ids", "tfs", "dls")]  # a posting is one number, as blocks are shuffled


@pytest.mark.parametrize(("query", "limit", "where"), [("rare", 5, None), ("all b rare rare", 10, "kind = 'x'"), ("rare a", 15, "kind <> 'z'"), ("nothing", 4, None), ("", 3, None)])
def test_the_same_rows_as_keyword_search(corpus, query, limit, where):
    docs, built = corpus
    where = None if where is None else F.expr(where)
    got = blockmax.search(built, docs, query, limit, where=where, first=1)
    want = keyword.keyword_search(keyword.build_index(docs), docs, query, limit, where=where)
    assert got.rows.columns == want.columns
    assert [(r["id"], r["text"], pytest.approx(r["score"])) for r in want.collect()] == [(r["id"], r["text"], r["score"]) for r in got.rows.collect()]
