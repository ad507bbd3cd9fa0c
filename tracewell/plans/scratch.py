"""A folder for tables between jobs, and reliable checkpoints in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, as in tests on one machine, a temporary folder of this machine is used; a cluster fails.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not named and jsc.getCheckpointDir().isEmpty() and not jsc.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named and jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
    return f"{(named or jsc.getCheckpointDir().get()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    folder(df.sparkSession, "unused")
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``folder`` named."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
