"""Block-max search against plain keyword search."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import blockmax, keyword


@pytest.fixture(scope="module")
def corpus(spark):
    """Rare words stand together, so that bounds can tell ranges apart; one word is in every document."""
    rng = random.Random(4)
    texts = [" ".join(["all"] * rng.randint(0, 3) + rng.choices(["a", "b", "c", "d"], k=rng.randint(0, 9)) + (["rare"] * rng.randint(1, 4) if 300 <= k < 310 else []) + ["one"] * (k == 77)) for k in range(600)]
    docs = spark.createDataFrame([(k, t, "xyz"[k % 3]) for k, t in enumerate(texts)], "id long, text string, kind string").cache()
    index = keyword.build_index(docs).kept(lambda t: t.cache())
    return docs, blockmax.build_blocks(index, 16).kept(lambda t: t.cache())


@pytest.mark.parametrize(("query", "limit", "where"), [("rare", 5, None), ("rare a", 3, None), ("all b rare rare", 10, "kind = 'x'"), ("rare one", 15, "kind <> 'z'"), ("nothing", 4, None), ("", 3, None)])
def test_the_same_rows_as_keyword_search(corpus, query, limit, where):
    docs, built = corpus
    where = None if where is None else F.expr(where)
    got = blockmax.search(built, docs, query, limit, where=where, first=1)
    want = keyword.keyword_search(built.index, docs, query, limit, where=where).collect()
    assert [(r["id"], pytest.approx(r["score"])) for r in want] == [(r["id"], r["score"]) for r in got.rows.collect()]
    assert got.blocks_read <= got.blocks


def test_few_blocks_are_read_for_a_rare_word(corpus):
    docs, built = corpus
    assert blockmax.search(built, docs, "rare a", 3, first=1).blocks_read < 0.3 * blockmax.search(built, docs, "rare a", 3, first=1).blocks
    heads = built.blocks.agg(F.max("n").alias("n"), F.max(F.size("ids")).alias("size"), F.sum("n").alias("all")).first()
    assert heads["n"] == heads["size"] <= 16 and heads["all"] == built.index.postings.count()
