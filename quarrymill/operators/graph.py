"""Property graph from chunks: node and edge tables, each built to its end state in one pass.

Chunks have id, repo, path, language, framework_type, text, classes, api_routes, http_calls and
dependencies (file-level lists on every chunk).  Where several chunks write one node, the last
by chunk id wins; that is the scan order here.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import routes
from quarrymill.operators import extract
from quarrymill.session import large

#: Name fragments of classes that handle requests.
HANDLER_NAMES = ("controller", "resource", "handler")


def class_id(repo: Column, path: Column, name: Column) -> Column:
    return F.concat_ws("::", repo, path, name)


def usable_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with a repository and a path."""
    return chunks.filter((F.coalesce("repo", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != ""))


def last_by(rows: DataFrame, keys: list[str], values: list[str], order: str = "pos") -> DataFrame:
    """Per key the values of its last row; one aggregation with map-side combine."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def files_of(rows: DataFrame) -> DataFrame:
    """File nodes of chunks (pos, repo, path, language, framework_type): the first of each (repo, path) writes, the last such write stays."""
    firsts = rows.groupBy("repo", "path").agg(F.min("pos").alias("pos"), F.min_by(F.struct("language", "framework_type"), "pos").alias("v"))
    named = firsts.select("path", "pos", F.col("v.language").alias("language"), F.col("v.framework_type").alias("framework_type"))
    return last_by(named, ["path"], ["language", "framework_type"]).withColumnRenamed("path", "id")


def handler_name(classes: Column) -> Column:
    """The first class named like a handler, else the first class, else null."""
    is_handler = lambda c: F.exists(F.array(*[F.lit(h) for h in HANDLER_NAMES]), lambda h: F.contains(F.lower(c), h))
    return F.coalesce(F.get(F.filter(classes, is_handler), F.lit(0)), F.get(classes, F.lit(0)))


def _verb(call: Column) -> Column:
    return F.upper(F.element_at(F.split(call, " ", 2), 1))


def _path(call: Column) -> Column:
    return F.element_at(F.split(call, " ", 2), 2)


def _with_verb(calls: Column) -> Column:
    """Entries of the form ``VERB path``; those without a blank are dropped."""
    return F.filter(calls, lambda c: F.size(F.split(c, " ", 2)) == 2)


def _by_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of routes that agree wherever neither has a placeholder, for routes with one.

    A route's mask says which segments are placeholders.  Each side meets the distinct masks of
    the other with its verb and size, which are few, and joins on its own segments with those
    under either mask blanked.
    """
    segments = lambda c: F.split(F.regexp_replace(c, "^/+|/+$", ""), "/")

    def masked(rows: DataFrame, route: str) -> DataFrame:
        return rows.withColumn("parts", segments(F.col(route))).withColumn("mask", F.transform("parts", lambda p: p == routes.PARAM))

    def keyed(rows: DataFrame, others: DataFrame, own: str, other: str) -> DataFrame:
        masks = others.select("verb", F.size("mask").alias("size"), F.col("mask").alias(other)).distinct()
        met = rows.withColumn("size", F.size("mask")).withColumnRenamed("mask", own).join(masks, ["verb", "size"])
        blank = F.zip_with(F.col(own), F.col(other), lambda x, y: x | y)
        return met.filter(F.exists(blank, lambda v: v)).withColumn("key", F.array_join(F.zip_with("parts", blank, lambda p, v: F.when(v, "*").otherwise(p)), "/")).drop("parts", "size")

    x, y = masked(a, "front"), masked(b, "back")
    return keyed(x, y, "mask_a", "mask_b").join(keyed(y, x, "mask_b", "mask_a"), ["verb", "mask_a", "mask_b", "key"]).select("verb", "front", "back")


def resolve_routes(fronts: DataFrame, backs: DataFrame) -> DataFrame:
    """(verb, front, back, match_quality) of distinct routes in normal form that match.

    Each way to match has an equi join of its own, so no pair is tried only because its verbs
    agree: equal routes on the route, prefixes on the exploded prefixes of the longer one, and
    templates on the segments that are literal under the placeholders of both.
    """
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n)))
    a, b = fronts.select("verb", "front").distinct(), backs.select("verb", "back").distinct()
    exact = a.join(b.withColumn("front", F.col("back")), ["verb", "front"])
    below = b.filter("back <> ''").withColumn("front", prefixes(F.col("back"))).join(a.filter("front <> ''"), ["verb", "front"])
    above = a.filter("front <> ''").withColumn("back", prefixes(F.col("front"))).join(b.filter("back <> ''"), ["verb", "back"])
    slots = _by_masks(a, b)
    pairs = exact.select("verb", "front", "back")
    for more in (below, above, slots):
        pairs = pairs.unionByName(more.select("verb", "front", "back"))
    quality = routes.match_quality(F.col("front"), F.col("back"))
    return pairs.withColumn("match_quality", quality).filter("match_quality <> 'none'").distinct()


def resolve_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Links (src, dst, match_quality, confidence) of calls to endpoints of the same verb.

    Routes that were normalised once are normalised again for matching, as the match itself does.
    """
    left = calls.select(F.col("id").alias("src"), F.upper("method").alias("verb"), routes.normalized(F.col("normalized_path")).alias("front"))
    right = endpoints.select(F.col("id").alias("dst"), F.upper("method").alias("verb"), routes.normalized(F.col("normalized_path")).alias("back"))
    linked = left.join(resolve_routes(left, right), ["verb", "front"]).join(right, ["verb", "back"])
    return linked.select("src", "dst", "match_quality", routes.confidence(F.col("match_quality")).alias("confidence"))


class Graph:
    """Nodes by label and edges by type; nodes have an ``id``, edges ``src`` and ``dst``.

    Tables are materialised once, when they are first asked for, as queries join them many
    times; what a query does not ask for is not built.
    """

    def __init__(self, chunks: DataFrame):
        self._chunks = chunks

    @cached_property
    def _rows(self) -> DataFrame:
        return large(usable_chunks(self._chunks).select(
            F.col("id").alias("pos"), "repo", "path", "language", "framework_type", F.substring("text", 1, extract.SNIPPET).alias("text"), "classes",
            _with_verb(F.col("api_routes")).alias("routes"),
            F.array_union(_with_verb(F.col("http_calls")), extract.http_calls(F.col("text"), F.col("language"))).alias("calls"),
            F.array_union("dependencies", extract.dependencies(F.col("text"), F.col("language"))).alias("deps"),
        ))

    @cached_property
    def repos(self) -> DataFrame:
        return large(self._rows.select(F.col("repo").alias("id")).distinct())

    @cached_property
    def files(self) -> DataFrame:
        return large(files_of(self._rows))

    @cached_property
    def belongs_to(self) -> DataFrame:
        return large(self._rows.select(F.col("path").alias("src"), F.col("repo").alias("dst")).distinct())

    @cached_property
    def classes(self) -> DataFrame:
        return large(last_by(self._defined, ["id", "name", "repo", "path"], ["kind"]))

    @property
    def defined_in(self) -> DataFrame:
        return self.classes.select(F.col("id").alias("src"), F.col("path").alias("dst"))

    @property
    def _routed(self) -> DataFrame:
        routed = self._rows.select("pos", "repo", "path", handler_name(F.col("classes")).alias("handler"), F.explode("routes").alias("r")).select(
            "pos", "repo", _verb(F.col("r")).alias("method"), _path(F.col("r")).alias("route"), F.when(F.col("handler").isNotNull(), class_id(F.col("repo"), F.col("path"), F.col("handler"))).alias("handler")
        )
        return routed.withColumn("id", F.concat_ws("::", "method", "route"))

    @cached_property
    def endpoints(self) -> DataFrame:
        return large(
            last_by(self._routed, ["id", "method", "route"], ["repo"]).withColumnRenamed("route", "path").withColumn("normalized_path", routes.normalized(F.col("path")))
        )

    @cached_property
    def handles(self) -> DataFrame:
        return large(self._routed.filter("handler is not null").select(F.col("handler").alias("src"), F.col("id").alias("dst")).distinct())

    @property
    def _called(self) -> DataFrame:
        called = self._rows.select("pos", "repo", "path", F.get("classes", F.lit(0)).alias("caller"), F.explode("calls").alias("c")).select(
            "pos", "repo", _verb(F.col("c")).alias("method"), _path(F.col("c")).alias("route"), F.when(F.col("caller").isNotNull(), class_id(F.col("repo"), F.col("path"), F.col("caller"))).alias("caller")
        )
        return called.withColumn("id", F.concat_ws("::", F.lit("call"), "repo", "method", "route"))

    @cached_property
    def http_calls(self) -> DataFrame:
        return large(self._called.select("id", "method", F.col("route").alias("path"), routes.normalized(F.col("route")).alias("normalized_path"), "repo").distinct())

    @cached_property
    def makes(self) -> DataFrame:
        return large(self._called.filter("caller is not null").select(F.col("caller").alias("src"), F.col("id").alias("dst")).distinct())

    @property
    def _wanted(self) -> DataFrame:
        # each class of a chunk depends on each dependency of the chunk that is a class of the repository
        return self._rows.select("pos", "repo", "path", "classes", F.explode("deps").alias("dep")).select(
            "pos", "repo", "dep", F.explode(F.transform("classes", lambda c: class_id(F.col("repo"), F.col("path"), c))).alias("src")
        )

    @property
    def _defined(self) -> DataFrame:
        of_class = self._rows.select("pos", "repo", "path", "language", "text", F.explode("classes").alias("name"))
        return of_class.withColumns({"id": class_id(F.col("repo"), F.col("path"), F.col("name")), "kind": extract.class_kind(F.col("text"), F.col("name"), F.col("language"))})

    @cached_property
    def depends_on(self) -> DataFrame:
        wanted = self._wanted.select("repo", "dep", "src")
        known = self.classes.select("repo", F.col("name").alias("dep"), F.col("id").alias("dst"))
        return large(wanted.distinct().join(known, ["repo", "dep"]).select("src", "dst").distinct())

    @cached_property
    def resolves_to(self) -> DataFrame:
        return large(resolve_calls(self.http_calls, self.endpoints))


def build_graph(chunks: DataFrame) -> Graph:
    """All nodes and edges of the chunks; dependency edges as repeated builds converge to them."""
    return Graph(chunks)


def live_stats(graph: Graph) -> DataFrame:
    """(label, n): nodes by label and resolved calls."""
    tables = {"repos": graph.repos, "files": graph.files, "classes": graph.classes, "endpoints": graph.endpoints, "http_calls": graph.http_calls, "resolved_calls": graph.resolves_to}
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("label"), "n") for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_stats(chunks: DataFrame) -> DataFrame:
    """One row: distinct repositories and files; classes, endpoints and calls counted on every chunk."""
    calls = F.array_union(_with_verb(F.col("http_calls")), extract.http_calls(F.col("text"), F.col("language")))
    return usable_chunks(chunks).agg(
        F.countDistinct("repo").alias("repos"),
        F.countDistinct("repo", "path").alias("files"),
        F.coalesce(F.sum(F.size("classes")), F.lit(0)).alias("classes"),
        F.coalesce(F.sum(F.size(_with_verb(F.col("api_routes")))), F.lit(0)).alias("endpoints"),
        F.coalesce(F.sum(F.size(calls)), F.lit(0)).alias("http_calls"),
    )
