import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from quarrymill.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DATA)
    assert set(want.columns) == set(got.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline_stages_shrink_and_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            docs = docs.cache()
        now = docs.count()
        assert 0 < now <= before and (now == before or name in ("toxicity", "n-gram Jaccard join", "mixing"))
        before = now


def test_entry_registers_everything():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
