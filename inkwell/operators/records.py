"""Record sets: scored results and their algebra, order and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.compat import DEFAULT, Compat

UNITS = {"document": ("rid",), "section": ("rid", "sid"), "position": ("rid", "sid", "pos")}
_TYPES = {"sid": "int", "pos": "long"}


@dataclass(frozen=True)
class Records:
    """A DataFrame of (unit columns, score bigint, n_subrecs bigint[, subrecs array]); one row per unit."""

    df: DataFrame
    unit: tuple[str, ...] = ("rid",)
    compat: Compat = DEFAULT

    @staticmethod
    def empty(spark: SparkSession, unit: str = "document", rid: str = "long", compat: Compat = DEFAULT) -> Records:
        keys = UNITS[unit]
        kind = ", ".join(f"{k} {_TYPES.get(k, rid)}" for k in keys)
        return Records(spark.createDataFrame([], f"{kind}, score long, n_subrecs long"), keys, compat)

    def _same(self, other: Records) -> None:
        if self.unit != other.unit:
            raise ValueError(f"record sets of different units: {self.unit} and {other.unit}")

    def _on(self, other: DataFrame, how: str) -> DataFrame:
        return self.df.join(other, list(self.unit), how)

    # --- accumulation: what an operand does to the set so far

    def accumulate(self, hits: Records, op: str) -> Records:
        """or: insert or add scores; and: keep what is in both, adding; but: drop; adjust: add where present."""
        self._same(hits)
        keys = list(self.unit)
        if op == "but":
            return replace(self, df=self._on(hits.df.select(*keys), "left_anti"))
        b = hits.df.select(*keys, F.col("score").alias("score_"), F.col("n_subrecs").alias("n_"))
        a = self.df.select(*keys, "score", "n_subrecs")
        how = {"or": "full", "and": "inner", "adjust": "left"}[op]
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        n = zero("n_subrecs") if op == "adjust" else zero("n_subrecs") + zero("n_")
        return replace(self, df=a.join(b, keys, how).select(*keys, (zero("score") + zero("score_")).alias("score"), n.alias("n_subrecs")))

    # --- set algebra: scores of one side

    def union(self, other: Records) -> Records:
        """All of this set, and what only the other has; no scores are added."""
        self._same(other)
        rest = other._on(self.df.select(*self.unit), "left_anti")
        return replace(self, df=self.df.unionByName(rest, allowMissingColumns=True))

    def subtract(self, other: Records) -> Records:
        self._same(other)
        return replace(self, df=self._on(other.df.select(*self.unit), "left_anti"))

    def intersect(self, other: Records) -> Records:
        """What is in both. The smaller side's scores stay (this side's if equal, or always without that quirk)."""
        self._same(other)
        if not self.compat.intersect_keep_smaller:
            return replace(self, df=self._on(other.df.select(*self.unit), "left_semi"))
        keys = list(self.unit)
        a, b = self.df.select(*keys, "score", "n_subrecs"), other.df.select(*keys, F.col("score").alias("score_"), F.col("n_subrecs").alias("n_"))
        sizes = a.agg(F.count("*").alias("na_")).crossJoin(b.agg(F.count("*").alias("nb_")))
        left = F.col("na_") <= F.col("nb_")
        both = a.join(b, keys).crossJoin(F.broadcast(sizes))
        return replace(self, df=both.select(*keys, F.when(left, F.col("score")).otherwise(F.col("score_")).alias("score"), F.when(left, F.col("n_subrecs")).otherwise(F.col("n_")).alias("n_subrecs")))

    def difference(self, other: Records) -> tuple[Records, Records, int]:
        """(only here, only there, how many were in both)."""
        self._same(other)
        common = self._on(other.df.select(*self.unit), "left_semi").count()
        return self.subtract(other), other.subtract(self), common

    # --- order

    def sort(self, key: str | Column | None = None, limit: int = 0, ascending: bool = False) -> DataFrame:
        """By score, highest first, unless told otherwise; ties by the unit columns. A limit of 0 keeps all."""
        c = F.col("score") if key is None else F.col(key) if isinstance(key, str) else key
        out = self.df.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last(), *self.unit)
        return out.limit(limit) if limit > 0 else out

    def page(self, offset: int = 0, limit: int = 10) -> DataFrame:
        out = self.sort().offset(offset) if offset else self.sort()
        return out.limit(limit) if limit > 0 else out

    # --- groups

    def group(self, unit: str | None = "document", key: Column | None = None, where: Column | None = None, limit: int = 0, ascending: bool = False) -> Records:
        """Coarser records: scores add up, n_subrecs counts. With ``limit`` the best (ascending: lowest) records stay as ``subrecs``.

        ``key`` groups by a computed key instead (column ``key``), ``where`` drops records first.
        """
        df = self.df if where is None else self.df.where(where)
        if key is not None:
            df, keys = df.withColumn("key", key), ("key",)
        else:
            keys = UNITS[unit]
            if not set(keys) < set(self.unit):
                raise ValueError(f"{self.unit} can't be grouped to {keys}")
        kept = [c for c in self.unit if c not in keys]
        aggs = [F.sum("score").cast("long").alias("score"), F.count("*").alias("n_subrecs")]
        if not limit:
            return replace(self, df=df.groupBy(*keys).agg(*aggs), unit=keys)
        score = F.col("score").asc() if ascending else F.col("score").desc()
        # a bounded rank before the lists are made, so that no list is longer than the limit
        w = Window.partitionBy(*keys).orderBy(score, *kept)
        top = df.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= limit)
        lists = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn_", "score", *kept))).alias("s_"))
        lists = lists.select(*keys, F.transform("s_", lambda s: F.struct(s["score"].alias("score"), *[s[c].alias(c) for c in kept])).alias("subrecs"))
        return replace(self, df=df.groupBy(*keys).agg(*aggs).join(lists, list(keys)), unit=keys)

    def subrec(self, i: int) -> Column:
        """The i-th subrecord (from 0)."""
        return F.get(F.col("subrecs"), F.lit(i))

    # --- access

    def count(self) -> int:
        return self.df.count()

    def find(self, *unit: object) -> int:
        """Score of one record, 0 if it isn't there."""
        row = self.at(*unit)
        return row.score if row else 0

    def at(self, *unit: object) -> Row | None:
        cond = F.lit(True)
        for c, v in zip(self.unit, unit):
            cond &= F.col(c) == v
        return self.df.where(cond).first()

    def __iter__(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    def map_scores(self, f: Callable[[Column], Column]) -> Records:
        return replace(self, df=self.df.withColumn("score", f(F.col("score")).cast("long")))


def merge(sets: list[Records], limit: int = 0, ascending: bool = False) -> DataFrame:
    """Several sorted sets as one sorted list (rows aren't combined), with the number of the set each row is from."""
    out = None
    for i, r in enumerate(sets):
        part = r.df.select(*r.unit, "score", "n_subrecs").withColumn("source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    c = F.col("score")
    out = out.orderBy(c.asc() if ascending else c.desc(), *sets[0].unit, "source")
    return out.limit(limit) if limit else out
