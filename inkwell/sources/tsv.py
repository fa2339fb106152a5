"""Tab-separated input and output, and JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_tsv(spark: SparkSession, path: str, slots: list[str], key: str = "_key", types: dict[str, str] | None = None) -> DataFrame:
    """Rows of ``key \\t value ...``; lines with another number of fields are left out.

    A key that comes again replaces what came before: the last line wins, in
    the order of the input's files and lines. An empty line ends a file.
    """
    line = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    stop = line.where("value = ''").groupBy("file").agg(F.min("n").alias("stop"))
    line = line.join(F.broadcast(stop), "file", "left").where("stop is null or n < stop")  # a row per file at most
    return parse_lines(line, slots, key, types)


def parse_lines(line: DataFrame, slots: list[str], key: str = "_key", types: dict[str, str] | None = None) -> DataFrame:
    """The same from a DataFrame (value, n), n being the order of the lines."""
    part = F.split("value", "\t", -1)
    row = line.select("n", part.alias("p")).where(F.size("p") == len(slots) + 1)
    last = row.groupBy(F.col("p")[0].alias(key)).agg(F.max_by("p", "n").alias("p"))
    kind = types or {}
    return last.select(key, *[F.col("p")[i + 1].try_cast(kind.get(s, "string")).alias(s) for i, s in enumerate(slots)])


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.option("sep", "\t").option("header", header).option("quote", "").csv(path)


def tsv_lines(df: DataFrame, header: bool = False) -> DataFrame:
    """One text column: values joined by tabs, null as nothing; optionally a first line of names."""
    body = df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    return df.sparkSession.createDataFrame([("\t".join(df.columns),)], "value string").unionByName(body) if header else body


def json_lines(df: DataFrame, slots: list[str | Column] | None = None, offset: int = 0, limit: int = 10) -> DataFrame:
    """One JSON object per row, of the given slots; nulls are written. A limit of 0 or less gives all."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (slots or df.columns)]
    out = df.offset(offset) if offset else df
    out = out.limit(limit) if limit > 0 else out
    return out.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def json_objects(df: DataFrame, names: str, values: str) -> DataFrame:
    """JSON objects of an array of names and an array of values."""
    return df.select(F.to_json(F.map_from_arrays(names, values)).alias("value"))
