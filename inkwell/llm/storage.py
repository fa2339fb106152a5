"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell.sources.store import prepare, remove, shared_dir

__all__ = ["Written", "prepare"]

_left: list[tuple[SparkSession, str]] = []


class Written:
    """A Parquet table in the shared folder; ``drop`` deletes it once it is used up."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/inkwell/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        _left.append((self.spark, self.path))

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)
        if (self.spark, self.path) in _left:
            _left.remove((self.spark, self.path))


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        if spark.sparkContext._jsc is not None:
            try:
                remove(spark, path)
            except Exception:  # the session may be gone at exit
                return
