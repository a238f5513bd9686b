"""One object with the engine's entry points; every method returns a DataFrame unless noted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import chunking, code, dense, enrich, evidence, graph, graph_queries, hybrid, keyword, tickets
from quarrymill.operators.documents import document_parser, html_sections, markdown_sections, suffix
from quarrymill.operators.hybrid import QueryRequest
from quarrymill.operators.python_source import parsed_python, python_sections
from quarrymill.session import materialized
from quarrymill.sources.files import DOCUMENT_SUFFIXES, read_repository
from quarrymill.sources.ingest import Ingestion

KEY = ("repo", "path")
SECTION = (*KEY, "language", "section_idx", "title", "level", "kind", "content", "hierarchy", "own_related")
FACTS = ("framework_type", "classes", "symbols", "api_routes", "http_calls", "dependencies")
SUMMARY_QUERY = "README architecture overview major modules important files configuration setup"
SUMMARY_CHARS, SECTION_CHARS, MOST_SYMBOLS = 900, 1200, 50


def repository_chunks(files: DataFrame, sizes: chunking.ChunkSizes | None = None) -> DataFrame:
    """Chunks of files (repo, path, text) with file-level facts on each chunk; one row for each id.

    A file is known by repository and path.  PDF files count as documents whose text is given.
    Where files have a ``root``, a chunk's path is the one below it, and ``origin_path`` the whole
    one; ids are named by the whole one.
    """
    is_doc = suffix(F.col("path")).isin(*DOCUMENT_SUFFIXES)
    docs, sources = files.filter(is_doc), files.filter(~is_doc)
    parser = document_parser(F.col("path"))
    none = F.array().cast("array<string>")
    pages = html_sections(docs.filter(parser == "html"), KEY, "text").withColumn("language", F.lit("html")).withColumn("own_related", F.col("related_sections")).select(*SECTION)
    texts = markdown_sections(docs.filter(parser != "html"), KEY).withColumn("language", parser).withColumn("own_related", F.col("related_sections")).select(*SECTION)
    parsed = code.parsed_sources(sources)
    python = parsed_python(parsed.filter("language = 'python'"))
    trees = python_sections(python, KEY).withColumn("own_related", none).select(*SECTION)
    has_tree = F.col("py.parsed") & (F.size("py.sections") > 0)
    patterns = code.source_sections(parsed.filter("language <> 'python'").unionByName(python.filter(~has_tree).drop("py")), KEY).withColumn("own_related", none).select(*SECTION)
    sections = pages.unionByName(texts).unionByName(trees).unionByName(patterns)
    facts = parsed.select(*KEY, *FACTS).unionByName(
        docs.select(*KEY, F.lit(None).cast("string").alias("framework_type"), *[none.alias(c) for c in FACTS[1:]])
    )
    shown = enrich.relative_path(F.col("path"), F.col("root")) if "root" in files.columns else F.col("path")
    hashed = files.select(*KEY, enrich.source_hash(F.col("text")).alias("source_hash"), shown.alias("file_path"), *[v.alias(k) for k, v in enrich.path_flags(F.col("path")).items()])
    flags = ("is_readme", "is_architecture_doc", "is_config_doc")
    made = chunking.chunks(sections.join(hashed, list(KEY)), sizes, KEY).join(facts, list(KEY)).join(enrich.document_facts(sections), list(KEY))
    related = F.when(F.size("own_related") > 0, F.col("own_related")).otherwise(F.col("related_sections"))
    made = made.withColumn("related_sections", related).withColumnRenamed("path", "origin_path").withColumnRenamed("file_path", "path")
    made = made.withColumn("heading_hierarchy", F.col("section_hierarchy")).select(
        "id", "repo", "path", "language", "section", "heading_hierarchy", "section_hierarchy", "chunk_type", "text", "token_count", *FACTS,
        "prev_chunk_id", "next_chunk_id", "source_hash", "section_idx", "chunk_idx", "related_sections", *flags, "origin_path",
    )
    return chunking.last_wins(made, "id", ["section_idx", "chunk_idx"])


class Engine:
    """Search, graph and evidence over one table of chunks and the index tables kept beside it."""

    def __init__(
        self, spark: SparkSession, chunks: DataFrame, ticket_table: DataFrame | None = None, dim: int = dense.DIM,
        index: keyword.KeywordIndex | None = None, vectors: DataFrame | None = None, kept_graph=None,
    ):
        self.spark, self.chunks, self.ticket_table, self.dim = spark, chunks, ticket_table, dim
        self.index = index or keyword.build_index(chunks).kept(materialized)
        self.vectors = materialized(dense.hash_embedding(chunks, dim=dim)) if vectors is None else vectors
        self.graph = kept_graph or graph.build_graph(chunks)

    @classmethod
    def ingest(
        cls, spark: SparkSession, roots: dict[str, str], store: str | None = None, force: bool = False, pdf_text: Callable[[bytes], str] | None = None,
        keep_graph: bool = False, **options,
    ) -> Engine:
        """An engine over the files below each root, by repository name.

        With a ``store`` folder only new and changed files are parsed; chunks, index tables, the
        manifest and a record of the job are kept there (see ``sources.ingest``), and with
        ``keep_graph`` the tables of the graph too.
        """
        if not roots:
            raise ValueError("no source given")
        files = None
        for repo, root in roots.items():
            one = read_repository(spark, root, repo, pdf_text)
            files = one if files is None else files.unionByName(one)
        if store is None:
            return cls(spark, materialized(repository_chunks(files)), **options)
        kept = Ingestion(spark, store, dim=options.get("dim", dense.DIM), keep_graph=keep_graph)
        kept.run(files, repository_chunks, force, repos=roots)
        now = kept.store.snapshot()
        index = keyword.KeywordIndex.of(kept.table("postings", now), kept.table("lengths", now)).kept(materialized)
        return cls(spark, kept.table("chunks", now), index=index, vectors=kept.table("vectors", now), kept_graph=kept.graph.graph(now) if keep_graph else None, **options)

    def _dense(self, request: QueryRequest) -> DataFrame:
        kept = F.lit(True)
        if request.repo:
            kept = kept & (F.col("repo") == request.repo)
        if request.language:
            kept = kept & (F.col("language") == request.language)
        if section := request.section or request.heading:
            kept = kept & F.array_contains("section_hierarchy", section)
        asked = dense.hash_embedding(self.spark.createDataFrame([("q", request.query)], "id string, text string"), dim=self.dim)
        scored = self.chunks.filter(kept).select("id").join(dense.sparse_scores(self.vectors, asked), "id", "left")
        return scored.withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.desc("score"), "id").limit(request.candidates)

    def _keyword(self, request: QueryRequest) -> DataFrame:
        where = keyword.chunk_filter(request.repo, request.language, request.section or request.heading)
        return keyword.keyword_search(self.index, self.chunks, request.query, request.candidates, where=where).select("id", "score")

    def search(self, request: QueryRequest | str, **options) -> DataFrame:
        request = request if isinstance(request, QueryRequest) else QueryRequest(request, **options)
        legs = []
        if request.mode in ("hybrid", "dense"):
            legs.append(hybrid.candidate_list(self._dense(request), "dense"))
        if request.mode in ("hybrid", "keyword"):
            legs.append(hybrid.candidate_list(self._keyword(request), "bm25"))
        merged = hybrid.merge(legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1]))
        return hybrid.reranked(merged, self.chunks, request.query, request.limit)

    def related(self, chunk_id: str, limit: int = 5) -> DataFrame:
        """Dense search with a chunk's text in its repository, language and section; empty if unknown."""
        row = self.chunks.filter(F.col("id") == chunk_id).select("text", "repo", "language", "section").first()
        if row is None:
            return self.search("", limit=limit).limit(0)
        return self.search(QueryRequest(row["text"], row["repo"], limit, "dense", row["language"], row["section"]))

    def explain_section(self, path: str, heading: str, repo: str | None = None) -> DataFrame:
        """(summary): texts of the path's chunks under a heading, or of the three best results."""
        found = self.search(QueryRequest(f"{path} {heading}", repo, 8, "hybrid", section=heading, heading=heading))
        ranked = found.withColumn("_focused", (F.col("path") == path) & F.contains(F.lower(F.array_join("section_hierarchy", " ")), F.lit(heading.lower())))
        rows = F.array_sort(F.collect_list(F.struct((-F.col("rerank_score")).alias("s"), "merge_rank", F.substring("text", 1, SECTION_CHARS).alias("text"), "_focused")))
        focused = F.filter(F.col("rows"), lambda r: r["_focused"])
        chosen = F.when(F.size(focused) > 0, focused).otherwise(F.slice("rows", 1, 3))
        return ranked.agg(rows.alias("rows")).select(F.array_join(F.transform(chosen, lambda r: r["text"]), "\n\n").alias("summary"))

    def summarize_repo(self, repo: str) -> DataFrame:
        return hybrid.summary_of(self.search(QueryRequest(SUMMARY_QUERY, repo)), SUMMARY_CHARS, MOST_SYMBOLS)

    def endpoints(self, repo: str | None = None, only_repo: bool = False) -> DataFrame:
        return graph_queries.endpoint_catalog(self.graph, repo, only_repo)

    def trace(self, feature: str) -> DataFrame:
        return graph_queries.trace(self.graph, feature)

    def dependencies(self, name: str, repo: str | None = None) -> DataFrame:
        return graph_queries.dependencies_of(self.graph, name, repo)

    def explain(self, feature: str, mode: str = "union") -> DataFrame:
        return evidence.summary(self.trace(feature), mode)

    def report(self, feature: str) -> str:
        """The evidence of a feature as text, without a language model."""
        return evidence.report(self.trace(feature), self.chunks, feature)

    def stats(self) -> DataFrame:
        return graph.live_stats(self.graph)

    def tickets(self) -> DataFrame:
        return tickets.ticket_list(self.ticket_table)

    def ticket(self, key: str) -> DataFrame:
        return tickets.ticket(self.ticket_table, key)

    def plan(self, key: str) -> str:
        """The change plan of a ticket as text."""
        one = self.ticket(key)
        named = one.select(tickets.feature_keywords(F.col("affected_feature"), F.col("summary")).alias("k")).first()["k"]
        feature = named[0] if named else ""
        return tickets.plan_text(one, self.trace(feature), self.chunks, feature)

    def context(self, feature: str) -> str:
        """What a narrator of the feature may use, as text."""
        return evidence.narration_context(self.trace(feature), self.chunks, feature)
