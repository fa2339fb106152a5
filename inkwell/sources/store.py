"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Lets Python workers that start in another folder import this package."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


def prepare_active() -> None:
    """``prepare`` for the session at hand, where a UDF is made from columns alone."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. In local mode, as in tests, a folder of our own where it is unset; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: a cut of its lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/inkwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(old)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(at, path(new))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a path; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
