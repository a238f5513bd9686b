"""Dense search: hash embeddings, fixed dimensions, and cosine top-k with filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import digest_bucket, digest_sign

DIM = 1024


def hash_embedding(docs: DataFrame, key: str = "id", text: str = "text", dim: int = DIM) -> DataFrame:
    """Sparse hash embeddings (id, bucket, value) of unit length.

    Tokens are hashed once where they stand and summed by (id, bucket), combined before the shuffle;
    a norm is a window over the buckets of an id, at most ``dim``.  Documents without tokens have no rows.
    """
    lowered = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+")
    digests = docs.select(F.col(key).alias("id"), F.explode(F.filter(lowered, lambda t: t != "")).alias("token")).select("id", F.md5("token").alias("digest"))
    summed = digests.groupBy("id", digest_bucket(F.col("digest"), dim).alias("bucket")).agg(F.sum(digest_sign(F.col("digest"))).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return summed.withColumn("norm", norm).select("id", "bucket", (F.col("raw") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("value"))


def dense_vectors(sparse: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, vector) from sparse embeddings."""
    packed = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    at = F.sequence(F.lit(0), F.lit(dim - 1))
    return packed.select("id", F.transform(at, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("vector"))


def fit_dim(vector: Column, dim: int = DIM) -> Column:
    """Padded with zeros or cut to ``dim``, not scaled again."""
    return F.slice(F.concat(vector.cast("array<double>"), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The ``k`` nearest rows by cosine among those that satisfy ``where``; ties by key."""
    kept = vectors if where is None else vectors.filter(where)
    asked = F.array(*[F.lit(float(x)) for x in query])
    return kept.withColumn("score", cosine(F.col(vector), asked)).orderBy(F.desc("score"), key).limit(k)


def sparse_scores(sparse: DataFrame, query: DataFrame) -> DataFrame:
    """(id, score): inner products with one sparse query vector (bucket, value) of unit length."""
    asked = F.broadcast(query.select("bucket", F.col("value").alias("_q")))
    return sparse.join(asked, "bucket").groupBy("id").agg(F.sum(F.col("value") * F.col("_q")).alias("score"))
