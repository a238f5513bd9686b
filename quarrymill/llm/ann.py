"""Maximum inner product search with score-aware (anisotropic) quantisation.

A product quantiser with four bits for every dimension is fitted so that the part of a vector's
residual that is parallel to the vector costs more than the rest (Guo et al., 2020): that part
shifts large inner products.  Queries scan the codes by table look-ups, and what may belong to
the best is scored again exactly, in double precision on the original vectors.

All queries meet all vectors, in blocks: both sides are dealt into blocks of bounded size by a
hash of their id, a task joins one block of queries and one of vectors and keeps the best of
each query, and the blocks' lists are merged.

Edge cases: vectors that are null, zero or hold null or non-finite components, and those of
another length than most vectors, take no part, as queries or candidates; neither do rows with a
null id; a query's own id is no candidate; ties go to the smaller id; with fewer candidates than
asked for all are returned; repeated rows are candidates each, and one query together; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.vectors import dimension, hashed_sample, stacked, takes_part

#: Neighbours, vectors the quantiser is fitted on at most, rows in a block of vectors and of
#: queries about, cosine of the scores that matter (sets the weight of parallel error), and
#: standard errors of the estimated score within which a candidate is scored exactly.
TOP, SAMPLE, VECTOR_BLOCK, QUERY_BLOCK, THRESHOLD, ERRORS = 20, 8192, 8192, 16384, 0.2, 3.0
#: Centres of a subspace (four bits), its dimensions, rounds of fitting, and rows encoded at once.
CENTRES, WIDTH, PASSES, ROWS = 16, 1, 8, 1024


def _padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % (2 * WIDTH))))


@dataclass
class Quantiser:
    """Codebooks (subspaces, 16, width), the weight of parallel error, and the error of estimates by norms of residual and query."""

    books: np.ndarray
    parallel: float
    error: float = 0.0

    @classmethod
    def fit(cls, sample: np.ndarray, threshold: float = THRESHOLD) -> Quantiser:
        """Alternates codes and centres; each centre solves its weighted least squares exactly."""
        x = _padded(sample)
        n, d = x.shape
        parts = x.reshape(n, d // WIDTH, WIDTH)
        rng = np.random.default_rng(7)
        even = np.argsort(parts[:, :, 0], axis=0)[((np.arange(CENTRES) + 0.5) * n / CENTRES).astype(int)]
        start = parts[even, np.arange(d // WIDTH)].transpose(1, 0, 2) + rng.normal(0, 1e-6, (d // WIDTH, CENTRES, WIDTH))
        q = cls(start.copy(), max(0.0, (d - 1) * threshold**2 / (1 - threshold**2) - 1))
        norm2 = np.maximum((x**2).sum(1), 1e-30)
        for _ in range(PASSES):
            codes = q.encode(sample)
            along = np.einsum("nmw,nmw->nm", parts - q._decoded(codes), parts)
            total = along.sum(1)
            for m in range(len(q.books)):
                own, rest = parts[:, m], total - along[:, m]
                weight = q.parallel / norm2
                a = np.eye(WIDTH) + weight[:, None, None] * own[:, :, None] * own[:, None, :]
                b = own + (weight * ((own**2).sum(1) + rest))[:, None] * own
                sums_a, sums_b = np.zeros((CENTRES, WIDTH, WIDTH)), np.zeros((CENTRES, WIDTH))
                np.add.at(sums_a, codes[:, m], a)
                np.add.at(sums_b, codes[:, m], b)
                used = np.bincount(codes[:, m], minlength=CENTRES) > 0
                q.books[m, used] = np.linalg.solve(sums_a[used], sums_b[used][..., None])[..., 0]
        decoded = q._decoded(q.encode(sample)).reshape(n, d)
        other, residual = x[rng.permutation(n)], x - decoded
        lengths = np.linalg.norm(residual, axis=1) * np.linalg.norm(other, axis=1)
        q.error = float(np.sqrt(np.mean(((residual * other).sum(1) / np.maximum(lengths, 1e-30)) ** 2)))
        return q

    def _decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books)), codes]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes (rows, subspaces) by coordinate descent on the anisotropic loss."""
        return np.concatenate([self._encoded(vectors[k : k + ROWS]) for k in range(0, max(1, len(vectors)), ROWS)])

    def _encoded(self, vectors: np.ndarray) -> np.ndarray:
        x = _padded(vectors)
        n, d = x.shape
        parts = x.reshape(n, d // WIDTH, WIDTH)
        square = ((parts[:, :, None, :] - self.books[None]) ** 2).sum(3)
        along = (parts**2).sum(2)[:, :, None] - np.einsum("nmw,mkw->nmk", parts, self.books)
        codes = square.argmin(2)
        weight = (self.parallel / np.maximum((x**2).sum(1), 1e-30))[:, None]
        total = np.take_along_axis(along, codes[:, :, None], 2)[..., 0].sum(1)
        for _ in range(2):
            for m in range(codes.shape[1]):
                rest = total - along[np.arange(n), m, codes[:, m]]
                codes[:, m] = (square[:, m] + weight * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[np.arange(n), m, codes[:, m]]
        return codes.astype(np.uint8)

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        codes = self.encode(vectors)
        return codes[:, 0::2] << 4 | codes[:, 1::2]

    def errors(self, vectors: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Standard errors of the vectors' estimated products with a query of length 1."""
        codes = np.stack([packed.T >> 4, packed.T & 15], 2).reshape(len(vectors), -1)
        return self.error * np.linalg.norm(_padded(vectors) - self._decoded(codes).reshape(len(vectors), -1), axis=1)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Inner products of a query's parts with pairs of centres: (pairs, 256)."""
        one = np.einsum("mw,mkw->mk", _padded(query[None]).reshape(-1, WIDTH), self.books).astype(np.float32)
        return (one[0::2, :, None] + one[1::2, None, :]).reshape(-1, CENTRES * CENTRES)


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, so that they depend on nothing else."""
    out = np.zeros(len(vectors))
    for k, x in enumerate(query):
        out += vectors[:, k] * x
    return out


def candidates(estimate: np.ndarray, errors: np.ndarray, top: int) -> np.ndarray:
    """Places that may belong to the ``top`` largest: within ``ERRORS`` standard errors of the least of those estimates."""
    if len(estimate) <= top:
        return np.arange(len(estimate))
    first = np.argpartition(estimate, -top)[-top:]
    return np.flatnonzero(estimate >= estimate[first].min() - ERRORS * np.maximum(errors, errors[first].max()))


def scan_block(q: Quantiser, query_ids, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, packed: np.ndarray, top: int) -> pd.DataFrame:
    """The best of a block for each query: a scan of its codes, then exact scores.

    Scored exactly are all candidates estimated within ``ERRORS`` standard errors of the
    ``top``-th estimate, however many, so groups of near copies are ranked right.  The error is
    a candidate's own, or the largest of the ``top`` estimates' if that is more.
    """
    found, errors, packed = [], q.errors(vectors, packed), packed.astype(np.intp)
    for query_id, query in zip(query_ids, queries, strict=True):
        estimate, one = np.zeros(len(ids), np.float32), np.empty(len(ids), np.float32)
        for codes, values in zip(packed, q.tables(query), strict=True):
            np.take(values, codes, out=one, mode="clip")
            estimate += one
        estimate[ids == query_id] = -np.inf
        near = candidates(estimate, errors * np.linalg.norm(query), top)
        near = near[ids[near] != query_id]
        exact = inner_products(vectors[near], query)
        best = np.lexsort((ids[near], -exact))[:top]
        found.append((np.full(len(best), query_id), ids[near][best], exact[best]))
    columns = [np.concatenate(c) if found else [] for c in zip(*found, strict=True)] if found else [[], [], []]
    return pd.DataFrame({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})


def search(queries: DataFrame, vectors: DataFrame, top: int = TOP, sample: int = SAMPLE, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each query (vec_id, embedding) its ``top`` vectors: query_id, rank, vec_id, score."""
    part = takes_part(dimension(vectors))
    vectors, queries = (t.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null").filter(part) for t in (vectors, queries))
    fitted = hashed_sample(vectors, sample)
    schema = "query_id long, vec_id long, score double"
    if not len(fitted):
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    quantiser = Quantiser.fit(fitted)
    # block counts follow the tables; both are counts of rows, not limits
    n_vectors = 1 + vectors.count() // vector_block
    n_queries = 1 + queries.count() // query_block

    def coded(batches):
        for batch in batches:
            if len(batch):
                yield batch.assign(codes=[row.tobytes() for row in quantiser.packed(stacked(batch.embedding))])

    def block(n, salt):
        return F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # repeats of a query are one: their lists would fill each other's places
    queries = queries.dropDuplicates(["vec_id"])
    left = queries.withColumn("qb", block(n_queries, "query")).withColumn("vb", every(n_vectors))
    codes = vectors.mapInPandas(coded, vectors.withColumn("codes", F.lit(b"")).schema)
    right = codes.withColumn("vb", block(n_vectors, "vector")).withColumn("qb", every(n_queries))

    def joined(key, qs, vs):
        if not len(qs) or not len(vs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        packed = np.stack([np.frombuffer(c, np.uint8) for c in vs.codes]).T.copy()
        return scan_block(quantiser, qs.vec_id.to_numpy(), stacked(qs.embedding), vs.vec_id.to_numpy(), stacked(vs.embedding), packed, top)

    best = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(joined, schema)
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def exact_search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, top: int = TOP) -> list[list[int]]:
    """Brute force, for measuring recall in tests."""
    out = []
    for query, own in zip(queries, query_ids, strict=True):
        score = vectors @ query
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != own]
        out.append([int(ids[k]) for k in order[:top]])
    return out


#: The exact result in DuckDB, over the view ``embeddings``.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
