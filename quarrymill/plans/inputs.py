"""Inputs that registered queries derive from the tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A source file for each part: a controller, service or repository by its key, which depends
#: on the classes of half and a third of its key; controllers serve and call a route.
SUFFIX = "CASE pmod({k}, 3) WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' ELSE 'Repository' END"
JAVA = """concat(
  CASE pmod(p_partkey, 3) WHEN 0 THEN '@RestController' WHEN 1 THEN '@Service' ELSE '@Repository' END, '\\npublic class C', p_partkey, {own}, ' {{\\n',
  '  private final C', p_partkey div 2, {half}, ' half;\\n  protected C', p_partkey div 3, {third}, ' third;\\n',
  CASE WHEN pmod(p_partkey, 3) = 0 THEN concat('  @GetMapping("/api/p', p_partkey, '/items")\\n  P', p_partkey, 'Response get(P', p_partkey,
    'Request q) {{ return restTemplate.getForObject("/api/p', p_partkey div 2, '/items?x=1", q); }}\\n') ELSE '' END, '}}\\n')"""
TYPESCRIPT = """concat('@NgModule({{}})\\nexport class V', p_partkey, 'Component {{\\n  constructor(private a: C', p_partkey, 'Service, readonly b: Kafka', p_size,
  'Client) {{}}\\n  load() {{ this.http.get(\\'/api/p', p_partkey, '/items\\'); fetch(\\'/api/b', p_size, '\\', {{ method: \\'post\\' }}); axios.put(\\'http://x/', p_size,
  '\\'); }}\\n}}\\nrouter.post("/v', p_partkey, '");\\n// size ', p_size, '\\n')"""


PYTHON = """concat('\"\"\"Module ', p_partkey, '.\"\"\"\\nimport os\\nfrom pkg', p_partkey, ' import name\\n@app.get("/py', p_partkey, '/items")\\nasync def read_', p_partkey, '(q: int, r: P', p_partkey,
  ') -> str:\\n    \"\"\"Reads ', p_partkey, '.\"\"\"\\n    return Depends(svc', p_size, ')\\nclass M', p_partkey, 'Protocol:\\n    \"\"\"Class ', p_partkey,
  '.\"\"\"\\n    @cached\\n    def run(self, x: float):\\n        return x\\n')"""
GO = """concat('package main\\nimport "net/http"\\nfunc main() {\\n  http.HandleFunc("/go', p_partkey, '", h)\\n  http.HandleFunc("/all/', p_size, '", h)\\n}\\n// serves ', p_partkey, '\\n')"""


#: Nested declarations among strings, comments and literals that look like some; the first line moves with the key.
NESTED = {
    "java": """concat(repeat('\\n', cast(pmod(p_partkey, 4) as int)), '// class No {\\npublic class A', p_partkey, ' {\\n  String s = "} class B {";\\n  static class I', p_partkey,
  ' {\\n    int f', p_size, '(int a) {\\n      if (a > 0) { return 1; }\\n      return a;\\n    }\\n  }\\n  void g() { }\\n}\\n')""",
    "typescript": """concat(repeat('\\n', cast(pmod(p_partkey, 3) as int)), 'export class V', p_partkey, ' {\\n  t = `{ ${ "}" }`;\\n  load', p_size,
  '(x) {\\n    const o = { a: 1 };\\n    return o;\\n  }\\n}\\nfunction h', p_partkey, '() { }\\n')""",
    "go": """concat('package main\\ntype S', p_partkey, ' struct {\\n  a int\\n}\\nfunc (s *S', p_partkey, ') M', p_size, '(x int) interface{} {\\n  return `}`\\n}\\n')""",
}


def nested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, language, text) of a file in each language for each part."""
    parts, out = table(spark, sf_dir, "part"), None
    for language, text in NESTED.items():
        one = parts.selectExpr("p_partkey", f"'{language}' AS language", f"{text} AS text")
        out = one if out is None else out.unionByName(one)
    return out


def java_text() -> str:
    return JAVA.format(own=SUFFIX.format(k="p_partkey"), half=SUFFIX.format(k="(p_partkey div 2)"), third=SUFFIX.format(k="(p_partkey div 3)"))


def typescript_text() -> str:
    return TYPESCRIPT.format()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, repo, path, text) of two files for each part."""
    parts = table(spark, sf_dir, "part")
    repo = "CASE WHEN pmod(p_partkey, 10) = 0 THEN 'beta' ELSE 'alpha' END AS repo"
    java = parts.selectExpr("p_partkey", repo, "concat('src/C', p_partkey, '.java') AS path", f"{java_text()} AS text")
    script = parts.selectExpr("p_partkey", "'web' AS repo", "concat('web/v', p_partkey, '.ts') AS path", f"{typescript_text()} AS text")
    return java.unionByName(script)


def other_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, repo, path, text) of a Python and a Go file for each part."""
    parts = table(spark, sf_dir, "part")
    python = parts.selectExpr("p_partkey", "'tools' AS repo", "concat('tools/m', p_partkey, '.py') AS path", f"{PYTHON} AS text")
    return python.unionByName(parts.selectExpr("p_partkey", "'tools' AS repo", "concat('tools/g', p_partkey, '.go') AS path", f"{GO} AS text"))


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each source file, with its file-level facts."""
    parsed = code.parsed_sources(sources(spark, sf_dir))
    key = F.concat(F.lpad(F.col("p_partkey").cast("string"), 12, "0"), F.col("language"))
    return parsed.select(key.alias("id"), "repo", "path", "language", "framework_type", "text", "classes", "api_routes", "http_calls", "dependencies")


#: The same classes and edges in DuckDB, from the table's keys alone.
GRAPH_SQL = """
k AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 10 = 0 THEN 'beta' ELSE 'alpha' END AS repo FROM part),
c AS (SELECT k, s, repo, 'src/C' || k || '.java' AS path, 'C' || k || CASE k % 3 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' ELSE 'Repository' END AS name,
             CASE k % 3 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' ELSE 'repository' END AS kind FROM k
      UNION ALL SELECT k, s, 'web', 'web/v' || k || '.ts', 'V' || k || 'Component', 'component' FROM k),
cls AS (SELECT *, repo || '::' || path || '::' || name AS id FROM c),
java AS (SELECT * FROM cls WHERE repo <> 'web'),
dep AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM java a JOIN java b ON a.repo = b.repo AND b.k % 3 <> 0 AND (b.k = a.k // 2 OR b.k = a.k // 3)),
ends AS (SELECT 'GET' AS method, 'GET::/api/p' || k || '/items' AS id, '/api/p' || k || '/items' AS path, repo, id AS handler, name, k FROM java WHERE k % 3 = 0
         UNION ALL SELECT 'POST', 'POST::/v' || k, '/v' || k, repo, id, name, NULL FROM cls WHERE repo = 'web'),
calls AS (SELECT id AS caller_id, name AS caller, repo, path AS file, k // 2 AS target FROM java WHERE k % 3 = 0
          UNION ALL SELECT id, name, repo, path, k FROM cls WHERE repo = 'web'),
made AS (SELECT caller_id, target, 'call::' || repo || '::GET::/api/p' || target || '/items' || x AS call FROM calls, (SELECT unnest(['', '?x=1']) AS x) WHERE repo <> 'web' OR x = ''
         UNION ALL SELECT id, NULL, 'call::web::POST::/api/b' || s FROM cls WHERE repo = 'web')
"""

#: Fixed inputs of search queries.
KEYWORDS = "released under the mit license version"
FEATURE = "/p12"


def documents_as_chunks(docs: DataFrame, *more: str) -> DataFrame:
    """Documents with the columns that retrieval looks at, and those named."""
    return docs.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"), F.col("source").alias("repo"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"),
        F.col("source").alias("section"), F.array("source").alias("heading_hierarchy"), F.array("source", "lang").alias("section_hierarchy"), F.array("lang").alias("symbols"),
        F.when(F.col("n_chars") % 2 == 0, "express").alias("framework_type"),
        F.when(F.col("lang") == "en", "architecture").otherwise("markdown").alias("chunk_type"), *more,
    )
