"""Chunks of documents are made where a document is read: no text is shuffled, and white space is cut without patterns."""

from pyspark.sql import functions as F

from quarrymill.functions.text import stripped
from quarrymill.operators.chunking import ChunkSizes
from quarrymill.streaming.ingest import chunk_documents


def test_no_join_and_no_pattern_over_the_ends(spark):
    docs = spark.createDataFrame([("a", "# A\n\n one two. \n\n\tthree"), ("b", None), (None, "# N")], "path string, text string")
    made = chunk_documents(docs, ChunkSizes(1, 3, 1))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and r"^[\s\p{Z}]+" not in plan
    rows = made.orderBy("path", "section_idx", "chunk_idx").collect()
    assert {r["path"] for r in rows} == {"a", "b"} and rows[0]["text"].startswith("# A\n") and all(r["text"] == r["text"].strip() for r in rows)
    assert {r["source_hash"] for r in rows if r["path"] == "a"} == {docs.filter("path = 'a'").select(F.sha2("text", 256)).first()[0]}


def test_stripped_is_what_the_pattern_gives(spark):
    marks = [chr(k) for k in range(0x3100) if k]
    rows = spark.createDataFrame([(c + "x y" + c + c,) for c in marks] + [("",), (" \n\t ",), (None,)], "t string")
    by_pattern = F.regexp_replace(F.regexp_replace("t", r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+\z", "")
    assert rows.filter(~stripped(F.col("t")).eqNullSafe(by_pattern)).count() == 0
