"""A SparkSession with the settings that the engine's results and plans rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quarrymill", **conf: str) -> SparkSession:
    """UTC timestamps, adaptive plans with skew handling, and Arrow for the few Python parsers."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder: a short plan for what is joined many times.

    The folder is the session's ``spark.checkpoint.dir``.  Only where none is set and Spark runs
    in one process is a temporary one made; on a cluster that is an error.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


def unsized(df: DataFrame) -> DataFrame:
    """``df`` with no estimate of its size, so that no plan takes a large table for a small one.

    Estimates go back to the sizes of compressed files; what was made of these can be many times
    larger, and a broadcast of it fills the driver.  Adaptive plans still broadcast what was small
    when it was shuffled.
    """
    session, frame = df.sparkSession, df._jdf
    return DataFrame(session._jsparkSession.internalCreateDataFrame(frame.queryExecution().toRdd(), frame.schema(), False), session)


def large(df: DataFrame) -> DataFrame:
    """``materialized``, for a table that grows with the input and is joined: it has no estimate of its size."""
    return unsized(materialized(df))


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarrymill-"))
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the checkpoint folder, which all machines share."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
