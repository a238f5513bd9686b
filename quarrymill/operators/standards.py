"""Layer rules: dependencies between classes that the rules do not allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Which layers each layer may depend on.
ALLOWED = {"controller": ("service",), "service": ("repository", "service"), "repository": ()}


def violations(classes: DataFrame, depends_on: DataFrame) -> DataFrame:
    """(src, dst, src_kind, dst_kind) of edges from a layer with rules to one it may not use."""
    a = classes.select(F.col("id").alias("src"), F.col("kind").alias("src_kind"))
    b = classes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    rows = depends_on.join(a, "src").join(b, "dst").filter(F.col("src_kind").isin(*ALLOWED) & F.col("dst_kind").isin(*ALLOWED))
    fine = F.lit(False)
    for layer, to in ALLOWED.items():
        fine = fine | ((F.col("src_kind") == layer) & (F.col("dst_kind").isin(*to) if to else F.lit(False)))
    return rows.filter(~fine).select("src", "dst", "src_kind", "dst_kind")
