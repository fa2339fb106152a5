"""Key tables: identifiers, key searches and dictionary scans.

A key table is a DataFrame (id long, key string[, pocket int]).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import byte_offsets, mapped_apart, normalize_text, normalize_with_offsets
from inkwell.sources.store import prepare_active

#: Keys up to which a dictionary is sent to the workers whole; beyond, texts are cut and joined.
DICTIONARY_KEYS = 1_000_000
PATTERN_KEYS = 1000  # keys up to which a dictionary is one regular expression
POCKET_MAX = 0x3FFF


def create(keys: DataFrame, key: str = "key") -> DataFrame:
    """A key table of the different non-null keys, numbered in their order from 1.

    Numbers are dense without a global window: partitions are sorted, counted
    and offset.
    """
    return _numbered(keys.select(F.col(key).alias("key")).where("key is not null").distinct(), 0)


def _numbered(keys: DataFrame, base: int) -> DataFrame:
    from inkwell.sources.store import written

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(keys.repartitionByRange(n, "key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()), "keys")
    w = Window.partitionBy("part").orderBy("key")
    sizes = {r.part: r["count"] for r in ordered.groupBy("part").count().collect()}
    upto, at = {}, base
    for part in sorted(sizes):
        upto[part], at = at, at + sizes[part]
    offset = F.create_map(*[F.lit(x) for kv in upto.items() for x in kv])[F.col("part")] if upto else F.lit(base)
    return ordered.withColumn("id", (offset + F.row_number().over(w)).cast("long")).select("id", "key", F.lit(0).alias("pocket"))


def get_or_create(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The table with the keys it lacked, numbered after the highest id."""
    new = keys.select(F.col(key).alias("key")).where("key is not null").distinct().join(table, "key", "left_anti")
    top = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return table.select("id", "key", "pocket").unionByName(_numbered(new, top))


def at(table: DataFrame, key: str) -> DataFrame:
    """The row of one key, if it is there."""
    return table.where(F.col("key") == key)


def key_of(table: DataFrame, id_: int) -> DataFrame:
    return table.where(F.col("id") == id_)


def delete(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.where(~F.col("key").isin(keys)) if keys else table


def size(table: DataFrame) -> int:
    return table.count()


def set_pocket(table: DataFrame, key: str, value: int) -> DataFrame:
    """A small number kept with a key, 14 bits."""
    if not 0 <= value <= POCKET_MAX:
        raise ValueError(f"a pocket holds 0 to {POCKET_MAX}")
    return table.withColumn("pocket", F.when(F.col("key") == key, F.lit(value)).otherwise(F.col("pocket")))


def add_pocket(table: DataFrame, key: str, by: int) -> DataFrame:
    """Counts a key's pocket up or down within its 14 bits."""
    new = F.greatest(F.lit(0), F.least(F.lit(POCKET_MAX), F.col("pocket") + by))
    return table.withColumn("pocket", F.when(F.col("key") == key, new).otherwise(F.col("pocket")))


def scan(table: DataFrame) -> DataFrame:
    """All keys by rising id."""
    return table.orderBy("id")


def prefix_search(table: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    return table.where(F.col(key).startswith(prefix))


def suffix_search(table: DataFrame, suffix: str, key: str = "key", linked: bool = True) -> DataFrame:
    """Keys that end with ``suffix``. A ``linked`` table knows suffixes of non-ASCII keys only, and needs the suffix itself as a key."""
    got = table.where(F.col(key).endswith(suffix))
    if linked:
        if not suffix or ord(suffix[0]) < 0x80:
            return table.where(F.col(key) == suffix)
        if at(table.withColumnRenamed(key, "key"), suffix).isEmpty():
            return table.limit(0)
    return got


def common_prefix_search(table: DataFrame, text: str, key: str = "key") -> DataFrame:
    """The longest key that begins ``text``."""
    starts = [text[:i] for i in range(1, len(text) + 1)]
    return table.where(F.col(key).isin(starts)).orderBy(F.length(key).desc()).limit(1)


def common_prefix_join(texts: DataFrame, column: str, table: DataFrame, key: str = "key", longest: int | None = None) -> DataFrame:
    """Each row of ``texts`` with the longest key that begins its text (column ``found``), null if none does.

    An equi-join on the prefixes of the text, whose length the longest key bounds.
    """
    most = longest or table.agg(F.max(F.length(key))).first()[0] or 0
    named = texts.withColumn("row_", F.monotonically_increasing_id())
    cut = named.select("row_", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(column), F.lit(most)).cast("int")), lambda n: F.substring(F.col(column), F.lit(1), n))).alias("found")) if most else named.select("row_", F.lit(None).cast("string").alias("found"))
    cut = cut.where("found <> ''")
    best = cut.join(table.select(F.col(key).alias("found")).distinct(), "found").groupBy("row_").agg(F.max_by("found", F.length("found")).alias("found"))
    return named.join(best, "row_", "left").drop("row_")


class _Trie:
    def __init__(self, keys: Iterator[str]):
        self.ids: dict[str, str] = {}
        self.prefixes: set[str] = set()
        for k in keys:
            n = "".join(normalize_with_offsets(k)[0])
            if n:
                self.ids[n] = min(k, self.ids.get(n, k))
                self.prefixes.update(n[:i] for i in range(1, len(n) + 1))
        self.first = {p for p in self.prefixes if len(p) == 1}
        longest = sorted(self.ids, key=len, reverse=True)
        self.pattern = re.compile("|".join(map(re.escape, longest)), re.DOTALL) if 0 < len(longest) <= PATTERN_KEYS else None

    def _matches(self, s: str) -> list[tuple[int, int]]:
        """Hits of the few keys of a dictionary: from the left, the longest first."""
        return [m.span() for m in self.pattern.finditer(s)]

    def scan(self, text: str, normalized: bool) -> list[tuple[str, int, int]]:
        if self.pattern is not None:
            s = mapped_apart(text) if normalized else text
            if s is not None:
                got = self._matches(s)
                if not got or len(s) == len(text) and not normalized:
                    starts, ends = range(len(s)), range(1, len(s) + 1)
                else:
                    _, starts, ends, _ = normalize_with_offsets(text, raw=not normalized)
                at = byte_offsets(text) if got else ()
                return [(self.ids[s[a:b]], at[starts[a]], at[ends[b - 1]] - at[starts[a]]) for a, b in got]
        chars, starts, ends, _ = normalize_with_offsets(text, raw=not normalized)
        s, i, out, at = "".join(chars), 0, [], byte_offsets(text)
        if self.pattern is not None:
            return [(self.ids[s[a:b]], at[starts[a]], at[ends[b - 1]] - at[starts[a]]) for a, b in self._matches(s)]
        while i < len(s):
            if chars[i] not in self.first:
                i += 1
                continue
            best, j = 0, i + 1
            while j <= len(s) and s[i:j] in self.prefixes:
                if s[i:j] in self.ids:
                    best = j
                j += 1
            if best:
                a = at[starts[i]]
                out.append((self.ids[s[i:best]], a, at[ends[best - 1]] - a))
                i = best
            else:
                i += 1
        return out


def dictionary_scan(texts: DataFrame, column: Column, table: DataFrame, key: str = "key", normalized: bool = True) -> DataFrame:
    """``texts`` with a row per dictionary hit: key, offset and length in bytes of the original text.

    Left to right, longest key first, hits don't overlap. A dictionary over
    DICTIONARY_KEYS is joined with all spans of the texts, with the same hits.
    Of keys that normalise alike the least is reported.
    """
    prepare_active()
    spark = texts.sparkSession
    kind = "array<struct<key:string,offset:int,length:int>>"
    if table.limit(DICTIONARY_KEYS + 1).count() > DICTIONARY_KEYS:
        return _scan_by_join(texts, column, table, key, normalized)
    shared = spark.sparkContext.broadcast(_Trie(r[0] for r in table.select(key).where(F.col(key).isNotNull()).toLocalIterator()))

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"key": k, "offset": o, "length": n} for k, o, n in shared.value.scan(x, normalized)] if isinstance(x, str) else [])

    return texts.withColumn("hit", F.explode(run(column))).select("*", "hit.*").drop("hit")


def _scan_by_join(texts: DataFrame, column: Column, table: DataFrame, key: str, normalized: bool = True) -> DataFrame:
    """All spans up to the longest key are joined with the dictionary; a fold per text then picks left to right.

    Texts and keys are normalised as in ``_Trie``; bytes of the original text go along by character.
    """

    @F.pandas_udf("struct<text:string,starts:array<int>,ends:array<int>>")
    def cut(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            x = x if isinstance(x, str) else ""
            chars, starts, ends, _ = normalize_with_offsets(x, raw=not normalized)
            at = byte_offsets(x)
            out.append(("".join(chars), [at[i] for i in starts], [at[i] for i in ends]))
        return pd.DataFrame(out, columns=["text", "starts", "ends"])

    keys = table.where(F.col(key).isNotNull()).select(normalize_text(F.col(key)).alias("k_"), F.col(key).alias("key")).where("k_ <> ''").groupBy("k_").agg(F.min("key").alias("key"))
    most = keys.agg(F.max(F.length("k_"))).first()[0] or 0
    named = texts.withColumn("row_", F.monotonically_increasing_id())
    at_ = named.select("row_", cut(column).alias("t_")).select("row_", "t_", F.col("t_.text").alias("text_")).where("text_ <> ''")
    at_ = at_.select("row_", "t_.ends", "text_", F.posexplode("t_.starts").alias("p", "offset")).withColumn("i", F.col("p") + 1)
    span = at_.select("row_", "i", "offset", "ends", "text_", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.length("text_") - F.col("p")))).alias("n")) if most else at_.withColumn("n", F.lit(0)).limit(0)
    span = span.select("row_", "i", "n", "offset", (F.element_at("ends", F.col("i") + F.col("n") - 1) - F.col("offset")).alias("length"), F.substring(F.col("text_"), F.col("i"), F.col("n")).alias("k_"))
    hit = span.join(keys, "k_").groupBy("row_", "i").agg(F.max_by(F.struct("i", "n", "offset", "length", "key"), "n").alias("h"))
    every = hit.groupBy("row_").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    kind = "array<struct<i:int,n:int,offset:int,length:int,key:string>>"
    picked = F.aggregate("hs", F.array().cast(kind), lambda acc, h: F.when((F.size(acc) == 0) | (h["i"] >= F.element_at(acc, -1)["i"] + F.element_at(acc, -1)["n"]), F.concat(acc, F.array(h).cast(kind))).otherwise(acc))
    out = every.select("row_", F.explode(picked).alias("h")).select("row_", "h.key", "h.offset", "h.length")
    return named.join(out, "row_").drop("row_")
