"""Helpers shared by the operators: table access, lineage cuts, hashing, ranking and batches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bits that ``monotonically_increasing_id`` leaves for the position inside a partition.
_POSITION_BITS = 33
#: Bytes of a batch that a Python worker turns into objects at a time.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of ``df`` as the struct ``row``, with further columns beside it.

    Whatever the columns of ``df`` are called, they cannot clash with those that an operator
    adds; ``select("row.*")`` gives them back as they were.
    """
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``size`` bytes, as long texts would crowd a small worker."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mapped(df: DataFrame, made: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType, size: int = SLICE_BYTES) -> DataFrame:
    """``made`` applied to ``df`` in pieces of about ``size`` bytes (nullable integers stay integers)."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in slices(batches, size):
            part = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)
            yield from pa.Table.from_pandas(made(part), arrow, preserve_index=False).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the cluster's shared folder.

    The folder is the one in ``spark.checkpoint.dir``.  Only where the session names none and
    runs in one process (tests) is a temporary one made; a cluster without one is an error,
    because its machines do not share local folders.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarrymill-"))
    return df.checkpoint(eager=True)


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the columns under different seeds, together a 128-bit key."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second seed"), *cols)


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") * F.lit(2.0**-53)


def globally_ranked(df: DataFrame, *order: str, rank: str = "rank") -> tuple[DataFrame, int]:
    """``df`` with a gapless 0-based ``rank`` by the ``order`` columns, and its row count.

    A range sort deals the rows out by all ``order`` columns, so a value that many rows share
    is split over tasks by the later columns.  The sorted rows are checkpointed, because range
    bounds come from a sample and must not be drawn twice; the driver sees one count for each
    partition only.
    """
    ordered = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    numbered = ordered.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", _POSITION_BITS).cast("int")
    sizes = {r["part"]: r["n"] for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), part)
    return numbered.withColumn(rank, start + F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))).drop("_at"), total
