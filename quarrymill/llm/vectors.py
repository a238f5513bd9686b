"""Vectors as rows of bytes: which take part, and how tasks read them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: str = "embedding") -> Column:
    """Whether a vector is there, not zero, and has neither null nor non-finite components."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def dimension(embeddings: DataFrame, vector: str = "embedding") -> int:
    """The length that most usable vectors have, the least of those that tie; 0 without any."""
    sizes = embeddings.filter(is_usable(vector)).groupBy(F.size(vector).alias("d")).count()
    first = sizes.orderBy(F.desc("count"), "d").first()
    return first["d"] if first else 0


def takes_part(d: int, vector: str = "embedding") -> Column:
    """Whether a vector is usable and has the length ``d``: products of unlike lengths mean nothing."""
    return is_usable(vector) & (F.size(vector) == d)


def stacked(column: pd.Series) -> np.ndarray:
    """A column of equally long arrays as a matrix of double precision."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def hashed_sample(rows: DataFrame, size: int, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """At most ``size`` vectors, those with the least hash of their key, for fitting on the driver."""
    found = rows.select(key, vector).orderBy(F.xxhash64(key), key).limit(size).toPandas()
    return stacked(found[vector])
