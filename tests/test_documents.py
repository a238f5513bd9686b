import re

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import chunking, documents, enrich
from quarrymill.operators.python_source import outline

MARKDOWN = """dropped
# Guide
## System design
Words about it.

#### Deep
```sh
# in a fence
```
## Settings
x
"""


def test_markdown_sections_keep_levels_and_lines(spark):
    docs = spark.createDataFrame([("a.md", MARKDOWN), ("b.md", "no heading\nline"), ("c.md", None)], "path string, text string")
    rows = documents.markdown_sections(docs).orderBy("path", "section_idx").collect()
    a = [r for r in rows if r["path"] == "a.md"]
    assert [(r["title"], r["level"], r["kind"]) for r in a] == [
        ("Guide", 1, "section"), ("System design", 2, "architecture"), ("Deep", 4, "code"), ("in a fence", 1, "code"), ("Settings", 2, "config"),
    ]
    assert [r["hierarchy"] for r in a][1:3] == [["Guide", "System design"], ["Guide", "System design", "Deep"]]
    assert a[4]["hierarchy"] == ["in a fence", "Settings"]
    assert [(r["line_start"], r["line_end"]) for r in a[:3]] == [(2, 3), (3, 6), (6, 8)]
    assert [(r["kind"], r["content"]) for r in rows if r["path"] != "a.md"] == [("document", "no heading\nline"), ("document", "")]


def test_html_sections(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><h1>Top <b>x</b></h1><p>one</p><p>two &amp; three</p><hr><p>after</p><h2>Sub</h2><pre>code</pre><script>no()</script></body></html>"
    rows = documents.html_sections(spark.createDataFrame([("u", page), ("v", "plain"), ("w", None)], "url string, html string")).orderBy("url", "section_idx").collect()
    assert [(r["url"], r["title"], r["level"], r["content"]) for r in rows] == [
        ("u", "Top x", 1, "Top x\none\ntwo & three"), ("u", "Sub", 2, "Sub\ncode"), ("v", None, 1, "plain"), ("w", None, 1, ""),
    ]


def count(text):
    return max(1, len(re.findall(r"\w+|[^\w\s]", text)))


def plain_chunks(text, sizes):
    parts = []
    for piece in re.split(r"(```[\s\S]*?```)", text):
        if piece.strip().startswith("```"):
            parts.append(piece.strip())
        else:
            parts += [p.strip() for p in re.split(r"\n\s*\n", piece) if p.strip()]
    done, current = [], []
    for block in parts or [text]:
        if current and count("\n\n".join([*current, block]).strip()) > sizes.most:
            done.append("\n\n".join(current).strip())
            kept, tokens = [], 0
            for b in reversed(current):
                kept.insert(0, b)
                tokens += count(b)
                if tokens >= sizes.overlap:
                    break
            current = [*kept, block]
        else:
            current.append(block)
    done.append("\n\n".join(current).strip())
    if len(done) < 2:
        return done
    out, held = [], ""
    for t in done:
        if count(t) >= sizes.least or not out:
            out.append(f"{held}\n\n{t}".strip() if held else t)
            held = ""
        else:
            held = f"{held}\n\n{t}".strip()
    if held:
        out[-1] = f"{out[-1]}\n\n{held}"
    return out


@pytest.mark.parametrize("sizes", [chunking.ChunkSizes(6, 14, 3), chunking.ChunkSizes(500, 20, 125), chunking.ChunkSizes(1, 5, 1)])
def test_chunks_as_a_plain_fold(spark, sizes):
    import random

    random.seed(4)
    texts = ["", "one", "```\na\n\nb\n```", *["\n\n".join(random.choice(["a b c", "x", "d e f g h i j k l m n o p q r s t", "```\ncode\n\nmore\n```", "end. now!"]) for _ in range(random.randint(1, 14))) for _ in range(12)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    made = rows.select("k", chunking.rebalanced(chunking.packed(chunking.blocks(F.col("t")), sizes), sizes).alias("c")).orderBy("k").collect()
    assert [[c["text"] for c in r["c"]] for r in made] == [plain_chunks(t, sizes) for t in texts]


def test_chunk_rows_have_ids_types_and_links(spark):
    sections = spark.createDataFrame(
        [("p", "markdown", "h", 0, "T", "section", "a\n\nb", ["T"]), ("p", "markdown", "h", 1, None, "config", "c", []), ("q", "java", "h", 0, "K", "class", "d", ["q", "K"])],
        "path string, language string, source_hash string, section_idx int, title string, kind string, content string, hierarchy array<string>",
    )
    rows = chunking.chunks(sections).orderBy("path", "section_idx").collect()
    assert [r["chunk_type"] for r in rows] == ["markdown", "config", "code"]
    assert rows[0]["next_chunk_id"] == rows[1]["id"] and rows[1]["prev_chunk_id"] == rows[0]["id"] and rows[2]["prev_chunk_id"] is None
    assert chunking.ChunkSizes.of(0, None, 9) == chunking.ChunkSizes(500, 1200, 9)


def test_enrichment(spark):
    row = enrich.enriched(spark.createDataFrame([("/r/docs/README.md", "x", ["c"] * 60)], "path string, text string, comments array<string>"), "/r").first()
    assert (row["file_path"], row["is_readme"], row["is_architecture_doc"], row["is_config_doc"], len(row["comments"])) == ("docs/README.md", True, True, False, 50)


def test_python_outline():
    found = outline('"""Doc."""\nimport os\nfrom a import b\n@app.get("/x")\ndef f(q: int) -> str:\n    "d"\nclass KProtocol:\n    def m(self): pass\n')
    assert found["routes"] == ["GET /x"] and found["functions"] == ["f", "KProtocol.m"] and found["interfaces"] == ["KProtocol"]
    assert found["imports"] == ["import os", "from a import b"] and found["annotations"] == ["int", "str"] and found["docstrings"] == ["Doc.", "d"]
    assert [s[0] for s in found["sections"]] == ["f", "KProtocol", "KProtocol.m"] and not outline("def (")["parsed"]
