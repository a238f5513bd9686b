"""Documents to sections: Markdown headings natively, HTML by a small parser on Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.text import columns, matches, non_empty, stripped

#: Heading lines, fenced blocks, and the terms that decide a section's kind.
HEADING = r"(?dm)^(#{1,6})\s+(.+)$"
FENCE = r"(?s)```(?:\w+)?\n(.*?)```"
ARCHITECTURE_TERMS = ("architecture", "design", "component", "module")
CONFIG_TERMS = ("config", "configuration", "settings", ".env")
HTML_SUFFIXES, PDF_SUFFIXES = (".html", ".htm"), (".pdf",)

SECTION = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("hierarchy", T.ArrayType(T.StringType())),
        T.StructField("related_sections", T.ArrayType(T.StringType())),
    ]
)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def document_parser(path: Column) -> Column:
    """html, pdf or markdown by file suffix; plain text counts as Markdown."""
    return F.when(suffix(path).isin(*HTML_SUFFIXES), "html").when(suffix(path).isin(*PDF_SUFFIXES), "pdf").otherwise("markdown")


def section_kind(title: Column, body: Column) -> Column:
    label = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(body, 1, 200)))
    some = lambda names: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(label, n))
    return F.when(some(ARCHITECTURE_TERMS), "architecture").when(some(CONFIG_TERMS), "config").when(F.contains(body, F.lit("```")), "code").otherwise("section")


def headings(text: Column) -> Column:
    return F.transform(matches(text, HEADING, 2), stripped)


def code_blocks(text: Column) -> Column:
    return matches(text, FENCE, 1)


def table_lines(text: Column) -> Column:
    """Lines with a pipe and a word character."""
    return F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")) & F.rlike(x, F.lit(r"[\p{L}\p{N}_]")))


def _line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def heading_hierarchies(levels: Column, titles: Column) -> Column:
    """For each heading the titles above it and its own; skipped levels shorten the list."""
    return F.aggregate(
        F.arrays_zip(levels.alias("level"), titles.alias("title")),
        F.array().cast("array<array<string>>"),
        lambda acc, h: F.array_append(
            acc,
            F.array_append(
                F.slice(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.array().cast("array<string>")), F.lit(1), h["level"] - 1), h["title"]
            ),
        ),
    )


def markdown_sections(docs: DataFrame, key: str | Sequence[str] = "path", text: str = "text") -> DataFrame:
    """One row for each heading, or one ``document`` section: key, section_idx and section columns.

    Text before the first heading is dropped.  Headings come from one match and the pieces
    between them from one split; lines are running sums over both, so a document is folded once.
    """
    keys = columns(key)
    cut = docs.select(*keys, F.coalesce(text, F.lit("")).alias("_t")).withColumn("_heads", matches(F.col("_t"), HEADING))
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    found = cut.filter(F.size("_heads") > 0).withColumns(
        {
            "_levels": F.transform("_heads", lambda h: F.length(F.regexp_extract(h, "^#+", 0))),
            "_titles": F.transform("_heads", lambda h: stripped(F.regexp_replace(h, r"^#{1,6}\s+", ""))),
            "_bodies": F.split("_t", HEADING),
        }
    )
    steps = F.zip_with("_heads", F.expr("slice(_bodies, 2, size(_heads))"), lambda h, b: newlines(h) + newlines(b))
    lines = F.aggregate(steps, F.array(newlines(F.get("_bodies", F.lit(0)))), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    found = found.withColumns({"_paths": heading_hierarchies(F.col("_levels"), F.col("_titles")), "_starts": lines})
    parts = F.arrays_zip("_heads", "_levels", "_titles", "_paths", F.expr("slice(_bodies, 2, size(_heads))").alias("_body"), "_starts", F.expr("slice(_starts, 2, size(_heads))").alias("_ends"))
    rows = found.select(*keys, F.posexplode(F.slice(parts, F.lit(1), F.size("_heads"))).alias("section_idx", "s"))
    rows = rows.withColumn("_body", stripped(F.col("s._body")))
    sections = rows.select(
        *keys,
        "section_idx",
        F.col("s._titles").alias("title"),
        F.col("s._levels").alias("level"),
        stripped(F.concat(F.col("s._heads"), F.lit("\n"), F.col("_body"))).alias("content"),
        section_kind(F.col("s._titles"), F.col("_body")).alias("kind"),
        (F.col("s._starts") + 1).alias("line_start"),
        (F.col("s._ends") + 1).alias("line_end"),
        F.col("s._paths").alias("hierarchy"),
        F.expr("slice(s._paths, 1, size(s._paths) - 1)").alias("related_sections"),
    )
    none = F.array().cast("array<string>")
    whole = cut.filter(F.size("_heads") == 0).select(
        *keys, F.lit(0).alias("section_idx"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("level"), F.col("_t").alias("content"),
        F.lit("document").alias("kind"), F.lit(1).alias("line_start"), F.greatest(F.lit(1), _line_count(F.col("_t"))).alias("line_end"),
        none.alias("hierarchy"), none.alias("related_sections"),
    )
    return sections.unionByName(whole)


class _Outline(HTMLParser):
    """Headings, code, tables and text of a page; text of scripts, styles and comments is left out."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    HIDDEN = frozenset(("script", "style"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.blocks = [], [], {"code": [], "table": []}
        self.sections = []  # of [level, title parts, depth, body parts, collecting]

    def handle_starttag(self, tag, attrs):
        depth = len(self.open)
        if tag.startswith("h"):  # any such sibling ends a section's body: h1 to h6, but also hr or header
            for s in self.sections:
                if s[4] and s[2] == depth and s[5]:
                    s[4] = False
        for name, own in (("code", ("pre", "code")), ("table", ("table",))):
            if tag in own:
                self.blocks[name].append([depth, [], True])
        for s in self.sections:
            if s[4] and s[5] and s[2] == depth:
                s[3].append([])
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.sections.append([int(tag[1]), [], depth, [], True, False])
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            closed = self.open.pop()
            depth = len(self.open)
            for s in self.sections:
                if s[4] and not s[5] and s[2] == depth:
                    s[5] = True  # the heading itself is closed; what follows is its body
                elif s[4] and s[5] and depth < s[2]:
                    s[4] = False
            for found in self.blocks.values():
                for b in found:
                    if b[2] and b[0] == depth:
                        b[2] = False
            if closed == tag:
                break

    def handle_data(self, data):
        if self.HIDDEN & set(self.open[-1:]):
            return
        part = data.strip()
        if not part:
            return
        self.texts.append(part)
        for s in self.sections:
            if s[4] and not s[5]:
                s[1].append(part)
            elif s[4] and s[5] and len(self.open) > s[2] and s[3]:
                s[3][-1].append(part)
        for found in self.blocks.values():
            for b in found:
                if b[2]:
                    b[1].append(part)


def html_outline(html: str | None) -> dict:
    """Text, headings, code blocks, tables, and sections (level, title, body) of a page."""
    parser = _Outline()
    parser.feed(html or "")
    parser.close()
    sections = [(s[0], " ".join(s[1]), "\n".join(x for x in (" ".join(p) for p in s[3]) if x)) for s in parser.sections]
    return {
        "text": "\n".join(parser.texts),
        "headings": [t for _, t, _ in sections],
        "code_blocks": ["\n".join(b[1]) for b in parser.blocks["code"]],
        "tables": [" ".join(b[1]) for b in parser.blocks["table"]],
        "levels": [n for n, _, _ in sections],
        "bodies": [b for _, _, b in sections],
    }


def html_documents(pages: DataFrame, key: str | Sequence[str] = "url", html: str = "html") -> DataFrame:
    """Key, text, headings, code_blocks, tables, and the levels and bodies of headings."""
    fields = "text string, headings array<string>, code_blocks array<string>, tables array<string>, levels array<int>, bodies array<string>"

    def outlined(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_outline(x) for x in column])

    parsed = F.pandas_udf(outlined, fields)
    return pages.select(*columns(key), parsed(F.col(html)).alias("p")).select(*columns(key), "p.*")


def html_sections(pages: DataFrame, key: str | Sequence[str] = "url", html: str = "html") -> DataFrame:
    """Sections of pages, as ``markdown_sections`` gives them; a page without headings is one."""
    keys, parsed = columns(key), html_documents(pages, key, html)
    paths = heading_hierarchies(F.col("levels"), F.col("headings"))
    rows = parsed.filter(F.size("headings") > 0).withColumn("paths", paths)
    rows = rows.select(*keys, "text", F.posexplode(F.arrays_zip("levels", "headings", "paths", "bodies")).alias("section_idx", "s"))
    last = F.greatest(F.lit(1), _line_count(F.col("text")))
    found = rows.select(
        *keys, "section_idx", F.col("s.headings").alias("title"), F.col("s.levels").alias("level"),
        stripped(F.concat(F.col("s.headings"), F.lit("\n"), F.col("s.bodies"))).alias("content"),
        section_kind(F.col("s.headings"), F.col("s.bodies")).alias("kind"), F.lit(1).alias("line_start"), last.alias("line_end"),
        F.col("s.paths").alias("hierarchy"), F.expr("slice(s.paths, 1, size(s.paths) - 1)").alias("related_sections"),
    )
    none = F.array().cast("array<string>")
    whole = parsed.filter(F.size("headings") == 0).select(
        *keys, F.lit(0).alias("section_idx"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("level"), F.col("text").alias("content"),
        F.lit("document").alias("kind"), F.lit(1).alias("line_start"), last.alias("line_end"), none.alias("hierarchy"), none.alias("related_sections"),
    )
    return found.unionByName(whole)


def document_metadata(sections: DataFrame, key: str | Sequence[str] = "path") -> DataFrame:
    """Per document: headings of readme files, titles of architecture and of config sections.

    The last column of ``key`` is the path; with several repositories it comes after theirs.
    """
    keys = columns(key)
    titled = lambda kind: non_empty(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("section_idx", "title")))), lambda s: F.coalesce(s["title"], F.lit("")))
    )
    every = F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "title"))), lambda s: s["title"])
    is_readme = F.startswith(F.lower(F.regexp_extract(F.first(keys[-1]), r"([^/]*)$", 1)), F.lit("readme"))
    return sections.groupBy(*keys).agg(
        F.when(is_readme, F.filter(every, lambda t: t.isNotNull())).otherwise(F.array().cast("array<string>")).alias("readme_structure"),
        titled("architecture").alias("architecture_sections"),
        titled("config").alias("config_sections"),
    )
