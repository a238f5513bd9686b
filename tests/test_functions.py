import hashlib
import re
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.functions import routes, text

TEXTS = ["", "a", "foo_bar, baz!", "naïve ²test x y", "日本 語 🙂", "a\r\nb", "`x`", "   pad  "]


def test_token_count_and_terms_as_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = rows.select(text.token_count(F.col("t")).alias("n"), text.terms(F.col("t")).alias("w"), text.stripped(F.col("t")).alias("s")).collect()
    for t, r in zip(TEXTS, got, strict=True):
        assert r["n"] == max(1, len(re.findall(r"\w+|[^\w\s]", t)))
        assert r["w"] == re.findall(r"[a-z0-9_]+", t.lower())
        assert r["s"] == t.strip()


def test_uuid5_and_hash_buckets_as_the_standard_library(spark):
    names = ["x", "docs/a.md:None:0:é", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = rows.select(text.uuid5(F.col("n")).alias("u"), *[text.hash_bucket(F.col("n"), d).alias(f"b{d}") for d in (1024, 300, 7)], text.hash_sign(F.col("n")).alias("s")).collect()
    for n, r in zip(names, got, strict=True):
        h = int(hashlib.md5(n.encode()).hexdigest(), 16)
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, n))
        assert [r["b1024"], r["b300"], r["b7"]] == [h % 1024, h % 300, h % 7]
        assert r["s"] == (1.0 if (h >> 8) & 1 else -1.0)


NORMAL = {
    "/api/users/123?x=1": "/api/users/{param}",
    "/api/users/": "/api/users",
    "/api/9b2d1c3e-1111-2222-3333-444455556666/a": "/api/{param}/a",
    "/api/{userId}/data": "/api/{param}/data",
    "/static/page": "/static/page",
    "api/x": "/api/x",
    "": "",
    "/": "",
    "123/x": "/123/x",
    "/a/12a/5.html": "/a/12a/5.html",
}
MATCHES = [
    ("/a/b", "/a/b", "exact"), ("/a/7", "/a/{id}", "exact"), ("/a/x", "/a/{id}", "template"), ("/api/a", "/api/ab", "prefix"),
    ("/a", "/a/b", "prefix"), ("/a/b", "/c/d", "none"), ("", "", "exact"), ("/a/${id}", "/a/{id}", "template"),
]


def test_routes(spark):
    rows = spark.createDataFrame(list(NORMAL.items()), "p string, want string")
    assert [r for r in rows.select("p", "want", routes.normalized(F.col("p")).alias("got")).collect() if r["got"] != r["want"]] == []
    pairs = spark.createDataFrame(MATCHES, "a string, b string, want string")
    got = pairs.select("*", routes.routes_match(F.col("a"), F.col("b")).alias("got")).withColumn("c", routes.confidence(F.col("got"))).collect()
    assert [r for r in got if r["got"] != r["want"]] == []
    assert {r["got"]: r["c"] for r in got} == {"exact": 1.0, "template": 0.85, "prefix": 0.6, "none": 0.4}


def plain_route(path):
    path = path.strip().split("?")[0].rstrip("/")
    path = re.sub(r"\{[^}]+\}", "{param}", path)
    head, *rest = path.split("/")
    path = "/".join([head, *("{param}" if re.fullmatch(r"\d+", s) else s for s in rest)])
    return "/" + path if path and not path.startswith("/") else path


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1/{}?. ", max_size=14), min_size=30, max_size=30))
def test_routes_by_a_plain_model(spark, paths):
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r["g"] for r in rows.select(routes.normalized(F.col("p")).alias("g")).collect()]
    assert got == [plain_route(p) for p in paths]
