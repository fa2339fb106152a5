"""Indexes that follow a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.index import VALUES, TextIndex
from inkwell.sources import store


def follow(docs: DataFrame, path: str, key: str, columns: list[str], checkpoint: str, order: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch becomes a delta of the index at ``path``, whole or not at all.

    Of a key that comes more than once in a batch the last by ``order`` counts.
    A batch that is run again after a failure finds its mark and is skipped.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = f"{path}/stream/{number}"
        if store.exists(spark, f"{mark}/_SUCCESS"):
            return
        rows = batch
        if batch.groupBy(key).count().where("count > 1").isEmpty():
            pass  # no key comes twice, so no text has to travel
        elif order:
            rows = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r_")).select(key, "r_.*")
        else:
            rows = batch.dropDuplicates([key])
        # empty and missing texts take their section out
        TextIndex.open(spark, path).upsert(_all_sections(rows, key, columns))
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(mark)

    out = docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def _all_sections(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    parts = []
    for i, c in enumerate(columns):
        value = F.struct(F.col(c).cast("string").alias("str"), F.lit(0).alias("weight"))
        parts.append(F.struct(F.lit(i + 1).alias("sid"), F.when(F.col(c).isNull(), F.array().cast(VALUES)).otherwise(F.array(value)).alias("values")))
    return rows.select(F.col(key).alias("rid"), F.explode(F.array(*parts)).alias("s")).select("rid", "s.sid", "s.values")


def read_tsv(spark: SparkSession, path: str, slots: list[str], key: str = "_key", files_per_batch: int = 1) -> DataFrame:
    """A stream of rows from tab-separated files; lines with another number of fields are left out."""
    line = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    part = F.split("value", "\t", -1)
    return line.select(part.alias("p")).where(F.size("p") == len(slots) + 1).select(F.col("p")[0].alias(key), *[F.col("p")[i + 1].alias(s) for i, s in enumerate(slots)])
