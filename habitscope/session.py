"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot account in a join even where a later shuffle has to be added for it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession, file_compression: float = 1.0) -> SparkSession:
    """Apply the runtime settings the operators rely on.

    Tables that :func:`cut` wrote take several times their files' size in memory; ``file_compression`` tells the
    planner, which would else broadcast tables of millions of rows by the size of their files.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(file_compression))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, which all executors share.

    Where nothing is named, a local master, whose executors are this process, gets a scratch folder; any other
    master is refused, because executors could not see a folder of the driver's machine.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        current = tempfile.mkdtemp(prefix="habitscope-")
        context.setCheckpointDir(current)
    return current


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return os.path.join(checkpoint_folder(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Write a table that many operators read to the checkpoint folder, once.

    Later stages then start from files that survive the loss of executors. The files are compressed columns, so they
    take little disk and each reader reads the columns it uses.
    """
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
