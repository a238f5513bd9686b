"""Facts from source files: symbols, routes, HTTP calls and dependencies, as column expressions.

The patterns are those of the ingest flavour; ``extract`` has the flavour used for the graph.
All rules look at one file's text and its language.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import columns, matches, sorted_distinct, stripped

#: Suffixes of source files and their languages; other suffixes name themselves.
LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "java": "java", "go": "go", "rs": "rust",
}
SOURCE_SUFFIXES = (*LANGUAGES, "rb", "php", "cs", "cpp", "c", "h")
SCRIPTS = ("typescript", "javascript")

#: What counts as an import, a class, and so on.
W = r"[\p{L}\p{N}_]"
IMPORT = r"(?dm)^(?:import|from|use|package|require|using)\s+[^;\n]+"
CLASS = rf"\bclass\s+([A-Za-z_]{W}*)"
INTERFACE = rf"\binterface\s+([A-Za-z_]{W}*)"
FUNCTION = rf"\b(?:function\s+|def\s+|func\s+)?([A-Za-z_]{W}*)\s*\([^)]*\)\s*(?:\{{|:)"
DECORATOR = r"(?dm)^\s*@([A-Za-z_][\p{L}\p{N}_.]*)"
VERB = "(get|post|put|delete|patch)"
PYTHON_ROUTE = rf"""(?i)@(?:app|router)\.{VERB}\(["']([^"']+)"""
SCRIPT_ROUTE = rf"""(?i)\b(?:app|router)\.{VERB}\(["']([^"']+)"""
JAVA_ROUTE = r"@(Get|Post|Put|Delete|Patch|Request)Mapping\(([^)]*)\)"
QUOTED = r"""["']([^"']+)["']"""
GO_ROUTE = r"""HandleFunc\(["']([^"']+)["']"""
SCRIPT_CLIENT = rf"""(?i)\.(?:http|httpClient|_http)\.{VERB}\s*[<(][^)]*?['"]([^'"]+)['"]"""
SCRIPT_FETCH = r"""fetch\(\s*['"]([^'"]+)['"]\s*(?:,\s*\{[^}]*?method\s*:\s*['"]([A-Za-z]+))?"""
SCRIPT_AXIOS = rf"""(?i)axios\.{VERB}\s*\(['"]([^'"]+)['"]"""
JAVA_CLIENT = rf"""(?i)(?:restTemplate|webClient)\.{VERB}ForObject\([^,]*['"]([^'"]+)['"]"""
JAVA_URI = r"""URI\.create\(['"]([^'"]+)['"]\)"""
JAVA_FIELD = rf"(?:private|protected)\s+(?:final\s+)?([A-Z]{W}+(?:Service|Repository|Repo|Client|Manager|Helper))\s+{W}+"
JAVA_AUTOWIRED = rf"@Autowired[^;]+?([A-Z]{W}+)\s+{W}+\s*;"
SCRIPT_CONSTRUCTOR = rf"constructor\s*\([^)]+?([A-Z]{W}+(?:Service|Client|Repository|Store|Facade))\b"
PYTHON_DEPENDS = rf"Depends\(([A-Za-z_]{W}*)\)"
PYTHON_COMMENT = r"(?dm)^\s*#.*$"
OTHER_COMMENT = r"(?dm)//.*$|(?s:/\*.*?\*/)"


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix), F.when(suffix == "", "text").otherwise(suffix))


def _joined(verbs: Column, paths: Column) -> Column:
    return F.zip_with(verbs, paths, lambda v, p: F.concat(F.upper(v), F.lit(" "), p))


def _pairs(text: Column, pattern: str) -> Column:
    return _joined(matches(text, pattern, 1), matches(text, pattern, 2))


def _rooted(calls: Column) -> Column:
    """Calls whose path starts with a slash."""
    return F.filter(calls, lambda c: F.rlike(c, F.lit("^[A-Z]+ /")))


def _nothing() -> Column:
    return F.array().cast("array<string>")


def framework(text: Column, language: Column) -> Column:
    lower = F.lower(text)
    has = lambda *names: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(lower, n))
    return (
        F.when((language == "python") & has("fastapi", "@app.get", "@router.get"), "fastapi")
        .when(language.isin(*SCRIPTS) & has("express("), "express")
        .when((language == "typescript") & has("@ngmodule"), "angular")
        .when((language == "java") & has("@restcontroller", "@requestmapping", "springapplication"), "spring-boot")
    )


def rest_endpoints(text: Column, language: Column) -> Column:
    """``VERB path`` of declared routes, with repeats, in order; Go routes have no verb.

    Java annotations need parentheses; a class-level prefix is not put before method paths.
    """
    java = F.zip_with(
        matches(text, JAVA_ROUTE, 1),
        matches(text, JAVA_ROUTE, 2),
        lambda name, args: F.concat(
            F.when(name == "Request", F.coalesce(F.nullif(F.regexp_extract(args, r"RequestMethod\.([A-Z]+)", 1), F.lit("")), F.lit("REQUEST"))).otherwise(F.upper(name)),
            F.lit(" "),
            F.coalesce(F.nullif(F.regexp_extract(args, QUOTED, 1), F.lit("")), F.lit("/")),
        ),
    )
    return (
        F.when(language == "python", _pairs(text, PYTHON_ROUTE))
        .when(language.isin(*SCRIPTS), _pairs(text, SCRIPT_ROUTE))
        .when(language == "java", java)
        .when(language == "go", matches(text, GO_ROUTE, 1))
        .otherwise(_nothing())
    )


def http_calls(text: Column, language: Column) -> Column:
    """``VERB path`` of outbound calls: script clients with rooted paths, Java clients with any."""
    fetched = F.zip_with(
        matches(text, SCRIPT_FETCH, 2), matches(text, SCRIPT_FETCH, 1), lambda v, p: F.concat(F.upper(F.coalesce(F.nullif(v, F.lit("")), F.lit("GET"))), F.lit(" "), p)
    )
    script = F.concat(_rooted(_pairs(text, SCRIPT_CLIENT)), _rooted(fetched), _rooted(_pairs(text, SCRIPT_AXIOS)))
    uris = _rooted(F.transform(matches(text, JAVA_URI, 1), lambda p: F.concat(F.lit("GET "), p)))
    return F.when(language.isin(*SCRIPTS), script).when(language == "java", F.concat(_pairs(text, JAVA_CLIENT), uris)).otherwise(_nothing())


def di_dependencies(text: Column, language: Column) -> Column:
    """Names of injected classes; of each script constructor the first that matches."""
    return (
        F.when(language == "java", F.concat(matches(text, JAVA_FIELD, 1), matches(text, JAVA_AUTOWIRED, 1)))
        .when(language.isin(*SCRIPTS), matches(text, SCRIPT_CONSTRUCTOR, 1))
        .when(language == "python", matches(text, PYTHON_DEPENDS, 1))
        .otherwise(_nothing())
    )


def comments(text: Column, language: Column) -> Column:
    pattern = F.when(language == "python", F.lit(PYTHON_COMMENT)).otherwise(F.lit(OTHER_COMMENT))
    return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), stripped)


def parsed_sources(files: DataFrame) -> DataFrame:
    """``files`` (path, text) with language, framework, lists of symbols, and raw symbol lists.

    Lists are sorted and distinct; ``symbols`` and ``headings`` keep order and repeats.
    """
    text, language = F.col("text"), F.col("language")
    named = files.withColumn("language", language_of(F.col("path"))).withColumns(
        {"_classes": matches(text, CLASS, 1), "_interfaces": matches(text, INTERFACE, 1), "_functions": matches(text, FUNCTION, 1), "_routes": rest_endpoints(text, language), "_decorators": matches(text, DECORATOR, 1)}
    )
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    marked = F.transform("_decorators", lambda d: F.concat(F.lit("@"), d))
    return named.withColumns(
        {
            "framework_type": framework(text, language),
            "imports": sorted_distinct(matches(text, IMPORT)),
            "classes": sorted_distinct(F.col("_classes")),
            "interfaces": sorted_distinct(F.col("_interfaces")),
            "functions": sorted_distinct(F.col("_functions")),
            "decorators": sorted_distinct(marked),
            "annotations": sorted_distinct(F.concat(marked, F.col("_decorators"))),
            "comments": comments(text, language),
            "api_routes": sorted_distinct(F.col("_routes")),
            "http_calls": sorted_distinct(http_calls(text, language)),
            "dependencies": sorted_distinct(di_dependencies(text, language)),
            "symbols": F.concat("_classes", "_functions", "_interfaces", "_routes"),
            "headings": F.concat(F.array(name), F.concat("_classes", "_interfaces", "_functions")),
        }
    ).drop("_routes", "_decorators")


def source_sections(parsed: DataFrame, key: str | Sequence[str] = "path") -> DataFrame:
    """Sections of parsed files: one for each class, interface and function, each the whole file.

    A file without any is one module section.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    of = lambda column, kind: F.transform(column, lambda s: F.struct(s.alias("title"), F.lit(2).alias("level"), F.lit(kind).alias("kind")))
    symbols = F.concat(of("_classes", "class"), of("_interfaces", "interface"), of("_functions", "function"))
    whole = F.array(F.struct(name.alias("title"), F.lit(1).alias("level"), F.lit("module").alias("kind")))
    rows = parsed.select(
        *columns(key), "language", F.col("text").alias("content"), F.posexplode(F.when(F.size(symbols) > 0, symbols).otherwise(whole)).alias("section_idx", "s"), name.alias("_name")
    )
    return rows.select(
        *columns(key), "language", "section_idx", F.col("s.title").alias("title"), F.col("s.level").alias("level"), F.col("s.kind").alias("kind"), "content",
        F.when(F.col("s.kind") == "module", F.array("_name")).otherwise(F.array(F.col("_name"), F.col("s.title"))).alias("hierarchy"),
    )
