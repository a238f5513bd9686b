"""Exact metric range join of vectors by cosine.

For unit vectors cosine >= c means distance <= r = sqrt(2 - 2c).  Pivots partition the vectors:
each has its home in the cell of its nearest pivot.  By the triangle inequality a vector can
have a link into another cell only if it lies within r of the bisecting plane between the
pivots and within r of the cell's radius; only then is it replicated there.  Cells are joined
independently: every home vector meets all members of its cell, in blocks of bounded size, so
each vector's links are counted in one cell.  Nothing is lost or estimated.

Identical vectors are one node with a multiplicity; nodes are told apart by a 128-bit hash of
the vector.  Edge cases: vectors that are null, zero or hold null or non-finite components, and
those of another length than most, link with nothing and are their own component; rows with a
null id are left out; rows that repeat an id are vectors of their own, linked by what they hold;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed, hash128
from quarrymill.llm.linking import SCHEMA, forest, reported, summed
from quarrymill.llm.vectors import dimension, hashed_sample, stacked, takes_part

COSINE = 0.9
#: Vectors in a cell and in a block about, and pivots at most (they go to every task).
CELL, BLOCK, MOST_PIVOTS = 8192, 8192, 4096
#: Products taken at a time in a block, and vectors dealt out at a time.
STRIP, DEALT = 1 << 20, 2048
#: What rounding may add to a distance between unit vectors.
SLACK = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def replicas(d: np.ndarray, between: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
    """Which cells each vector belongs to, from distances to pivots; the home cell always.

    If y has its home in cell j, its distance to the plane between pivots i and j is at least 0
    on j's side, and x's on i's side is (d_j^2 - d_i^2) / (2 |p_i - p_j|); with |x - y| <= r the
    latter is at most r.  Likewise d_j <= radius_j + r.
    """
    home = d.argmin(1)
    near = np.take_along_axis(d, home[:, None], 1)
    plane = (d**2 - near**2) / np.maximum(2 * between[home], 1e-12)
    out = (plane <= r + SLACK) & (d <= radius + r + SLACK)
    out[np.arange(len(d)), home] = True
    return out


def block_links(homes: np.ndarray, home_ids: np.ndarray, home_weights: np.ndarray, members: np.ndarray, member_ids: np.ndarray, member_weights: np.ndarray, cosine: float):
    """Links of home vectors with members: node ids, weighted counts, and the edges of a spanning forest.

    Products are taken in single precision; those near the threshold again in double.  Each
    strip of rows is folded into the forest at once, so the pairs of a dense group are held for
    ``STRIP`` products at most.
    """
    left, right = _unit(homes), _unit(members)
    ids = np.unique(np.concatenate([home_ids, member_ids]))
    at_home, at_member = np.searchsorted(ids, home_ids), np.searchsorted(ids, member_ids)
    counts, label, own = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.arange(len(ids))
    right32 = right.astype(np.float32).T.copy()
    rows = max(1, STRIP // max(1, len(right)))
    for lo in range(0, len(left), rows):
        product = left[lo : lo + rows].astype(np.float32) @ right32
        i, j = np.nonzero(product >= cosine - 1e-4)
        if not len(i):
            continue
        sure = home_ids[lo + i] != member_ids[j]
        close = np.flatnonzero(product[i, j] < cosine + 1e-4)
        for some in np.array_split(close, 1 + len(close) // 65536):
            sure[some] &= (left[lo + i[some]] * right[j[some]]).sum(1) >= cosine
        i, j = at_home[i[sure] + lo], j[sure]
        counts += np.bincount(i, member_weights[j], len(ids)).astype(np.int64)
        label = forest(np.concatenate([i, own]), np.concatenate([at_member[j], label]), len(ids))
    joined = np.flatnonzero(label != own)
    return ids, counts, joined, label[joined]


def range_join(embeddings: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id (least id reached) and kept."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null")
    part = takes_part(dimension(rows))
    h1, h2 = hash128(F.col("embedding"))
    keyed = rows.filter(part).withColumns({"h1": h1, "h2": h2})
    # one node for each distinct vector, numbered once in what the checkpoint holds: its least id and the number of its rows
    grouped = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    nodes = checkpointed(grouped.withColumn("node", F.monotonically_increasing_id()))
    total = nodes.count()
    r = math.sqrt(2 - 2 * cosine)
    pivots = _unit(hashed_sample(nodes, min(MOST_PIVOTS, 1 + total // cell), "low")) if total else np.zeros((1, 1))
    between = _distances(pivots, pivots)

    def radii(batches):
        for batch in batches:
            if len(batch):
                d = _distances(_unit(stacked(batch.embedding)), pivots)
                home = d.argmin(1)
                found = pd.DataFrame({"cell": home, "radius": d.min(1)}).groupby("cell").agg(radius=("radius", "max"), homes=("radius", "size"))
                yield found.reset_index()

    # one row for each pivot comes back, so at most MOST_PIVOTS
    measured = nodes.mapInPandas(radii, "cell int, radius double, homes long").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("homes").alias("homes")).collect()
    radius, homes = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for m in measured:
        radius[m["cell"]], homes[m["cell"]] = m["radius"], m["homes"]
    deals = 1 + homes // block  # blocks of home vectors in each cell
    spread = max(1, 1 + total // block)  # blocks of members; a cell may have every vector as member

    kind = np.float32 if nodes.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64

    def dealt(batches):
        """Each vector once as home for every member block, and as member for every home block of its cells.

        What a batch sends to one task is a single row: ids, weights and vectors as bytes.
        """
        for batch in batches:
            for at in range(0, len(batch), DEALT):
                part = batch.iloc[at : at + DEALT]
                node, weight, vectors = part.node.to_numpy(np.int64), part.weight.to_numpy(np.int64), stacked(part.embedding)
                d = _distances(_unit(vectors), pivots)
                home, belongs = d.argmin(1), replicas(d, between, radius, r) & (homes > 0)
                place = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                vectors = vectors.astype(kind)
                # members: a row for each home block of each of their cells; homes: one for each member block
                row, cells = np.nonzero(belongs)
                times = deals[cells]
                member, member_cell = np.repeat(row, times), np.repeat(cells, times)
                member_home = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                own = np.repeat(np.arange(len(part)), spread)
                chosen = np.concatenate([member, own])
                keys = np.stack([
                    np.concatenate([member_cell, home[own]]), np.concatenate([member_home, (place % deals[home])[own]]),
                    np.concatenate([(place % spread)[member], np.tile(np.arange(spread), len(part))]), np.repeat([0, 1], [len(member), len(own)]),
                ])
                order = np.lexsort(keys[::-1])
                keys, chosen = keys[:, order], chosen[order]
                starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
                groups = np.split(chosen, starts[1:])
                c, k, m, is_home = keys[:, starts]
                yield pd.DataFrame(
                    {
                        "cell": c, "home_block": k, "member_block": m, "is_home": is_home.astype(bool), "node": [node[g].tobytes() for g in groups],
                        "weight": [weight[g].tobytes() for g in groups], "vectors": [vectors[g].tobytes() for g in groups],
                    }
                )

    base = nodes.select("node", "weight", "embedding")
    schema = "cell int, home_block int, member_block int, is_home boolean, node binary, weight binary, vectors binary"

    def unpacked(rows):
        ids = np.frombuffer(b"".join(rows.node), np.int64)
        return np.frombuffer(b"".join(rows.vectors), kind).reshape(len(ids), -1).astype(np.float64), ids, np.frombuffer(b"".join(rows.weight), np.int64)

    def joined(rows):
        own, other = rows[rows.is_home], rows[~rows.is_home]
        if not len(own) or not len(other):
            return pd.DataFrame({"kind": [], "a": [], "b": [], "n": []})
        return reported(*block_links(*unpacked(own), *unpacked(other), cosine))

    reports = base.mapInPandas(dealt, schema).groupBy("cell", "home_block", "member_block").applyInPandas(joined, SCHEMA)
    counts, components = summed(reports)
    found = nodes.select("h1", "h2", "low", "weight", "node").join(counts, "node", "left").join(components, "node", "left")
    found = checkpointed(
        found.select("h1", "h2", "low", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    found = found.join(found.groupBy("component").agg(F.min("low").alias("component_id")), "component")
    known = keyed.select("vec_id", "h1", "h2").join(found, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The same in DuckDB, over the view ``embeddings``.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reached(node, low) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.node
), component AS (SELECT node AS vec_id, min(low) AS component_id FROM reached GROUP BY node),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
