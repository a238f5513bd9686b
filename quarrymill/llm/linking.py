"""What similarity joins share: links of a block reduced to a forest, and components of all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed
from quarrymill.llm.components import connected_components

#: What tasks return: for kind 0 the links ``n`` that node ``a`` has here, for kind 1 an edge a-b.
SCHEMA = "kind int, a long, b long, n long"


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The least node that each of ``nodes`` nodes reaches over the edges a-b."""
    label = np.arange(nodes)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label[label]]
        if (label == before).all():
            break
        live = label[a] != label[b]
        a, b = a[live], b[live]
    while (label[label] != label).any():
        label = label[label]
    return label


def reported(ids: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Link counts of ``ids`` and the edges of a spanning forest of the links a-b between them."""
    label = forest(a, b, len(ids))
    some, joined = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame(
        {
            "kind": np.repeat([0, 1], [len(some), len(joined)]).astype(np.int32),
            "a": np.concatenate([ids[some], ids[joined]]),
            "b": np.concatenate([ids[some], ids[label[joined]]]),
            "n": np.concatenate([counts[some], np.zeros(len(joined), np.int64)]).astype(np.int64),
        }
    )


def summed(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per node its links, and the component of each linked node."""
    reports = checkpointed(reports)
    counts = reports.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    return counts, connected_components(reports.filter("kind = 1").select("a", "b"))
