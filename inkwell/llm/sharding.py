"""Minimax contiguous partition of ordered groups into shards.

Groups (all rows with one key) are atomic and keep their order. The smallest
capacity for which the groups fit into k shards is found by binary search over
whole numbers; a capacity is checked greedily, each shard taking groups as long
as they fit. Cuts then go where the greedy check puts them.

Group sizes stay in a written table in their order. The driver holds one sum
for each block of ``BLOCK`` groups and reads the blocks that cuts fall into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.storage import Written, prepare

SHARDS = 8
BLOCK = 65536


class Sizes:
    """Prefix sums of ordered group sizes, read block by block."""

    def __init__(self, sums: np.ndarray, counts: np.ndarray, fetch):
        self.total = np.concatenate(([0], np.cumsum(sums)))
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.fetch, self.held = fetch, {}

    def _inside(self, block: int) -> np.ndarray:
        if block not in self.held:
            self.held |= self.fetch(range(block, block + 1))
        return self.held[block]

    def preload(self, blocks: list[int]) -> None:
        want = [b for b in blocks if b not in self.held]
        if want:
            self.held |= self.fetch(want)

    def reach(self, start: int, capacity: int) -> int:
        """Most groups from the first whose sum past the ``start`` sum is within capacity: (number of groups, their prefix sum)."""
        goal = start + capacity
        b = int(np.searchsorted(self.total, goal, side="right")) - 1
        if b >= len(self.total) - 1:
            return int(self.first[-1]), int(self.total[-1])
        inner = np.cumsum(self._inside(b)) + self.total[b]
        k = int(np.searchsorted(inner, goal, side="right"))
        return int(self.first[b]) + k, int(inner[k - 1]) if k else int(self.total[b])


def greedy(sizes: Sizes, capacity: int, shards: int) -> list[int] | None:
    """Group numbers at which shards 1, 2, ... begin, or None if it takes more than ``shards``."""
    cuts, at = [], 0
    for _ in range(shards):
        n, at = sizes.reach(at, capacity)
        if n >= sizes.first[-1]:
            return cuts
        cuts.append(n)
    return None


def smallest_capacity(sizes: Sizes, largest: int, shards: int) -> tuple[int, list[int]]:
    total = int(sizes.total[-1])
    lo = max(largest, -(-total // shards))
    block = int(np.diff(sizes.total).max(initial=0))
    # every capacity of lo plus a block is feasible with cuts at block ends; read where cuts can fall
    hi = min(total, lo + max(largest, block)) if shards > 1 else total
    while greedy(sizes, hi, shards) is None:
        hi = min(total, hi + max(block, largest, 1))
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(sizes, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo, greedy(sizes, lo, shards)


def assign(docs: DataFrame, key: str = "source", size: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """(doc_id, grp, shard) of every row, shards numbered from 0 in the order of ``key``.

    A row's size is the UTF-8 length of its text unless given (null: 0). A null
    key is a group of its own that comes first. Rows with equal keys share a
    shard, repeated rows count each, a null doc_id is reported as null. Fewer
    groups than shards leave later shards empty; an empty table gives no rows.
    Other columns aren't read.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = F.octet_length("text") if size is None else size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).cast("string").alias("grp"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"))

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in it:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))], ["grp", "size", "part", "pos"])
            n += b.num_rows

    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = groups.repartitionByRange(wide, F.col("grp").asc_nulls_first()).sortWithinPartitions(F.col("grp").asc_nulls_first())
    table = Written(ordered.mapInArrow(number, "grp string, size long, part int, pos long"), "groups")
    block = F.expr(f"pos div {BLOCK}")
    blocks = table.df.groupBy("part", block.alias("block")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m")).orderBy("part", "block").collect()
    if not blocks:
        return rows.select("doc_id", "grp", F.lit(0).alias("shard"))

    def fetch(which) -> dict[int, np.ndarray]:
        want = spark.createDataFrame([(i, blocks[i].part, blocks[i].block) for i in which], "i int, part int, block long")
        got = table.df.withColumn("block", block).join(F.broadcast(want), ["part", "block"]).select("i", "pos", "size").toArrow().to_pandas()
        return {int(i): g.sort_values("pos")["size"].to_numpy() for i, g in got.groupby("i")}

    sizes = Sizes(np.array([b.s for b in blocks], np.int64), np.array([b.n for b in blocks], np.int64), fetch)
    largest = max(b.m for b in blocks)
    around = []
    for j in range(1, shards):  # blocks near an even cut, in one job; others are read when a check needs them
        b = int(np.searchsorted(sizes.total, sizes.total[-1] * j // shards, side="right")) - 1
        around += [x for x in (b - 1, b, b + 1) if 0 <= x < len(blocks)]
    sizes.preload(sorted(set(around)))
    _, cuts = smallest_capacity(sizes, largest, shards)
    bounds = []
    for c in cuts:
        b = int(np.searchsorted(sizes.first, c, side="right")) - 1
        at = (blocks[b].part, blocks[b].block * BLOCK + c - int(sizes.first[b]))
        bounds.append(table.df.where((F.col("part") == at[0]) & (F.col("pos") == at[1])).first().grp)
    table.drop()
    if not bounds:
        shard = F.lit(0)
    else:  # a cut never falls before the first group, so bounds aren't null
        shard = F.when(F.col("grp").isNull(), F.lit(0)).otherwise(F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col("grp"))))
    return rows.select("doc_id", "grp", shard.cast("int").alias("shard"))


def sql(shards: int = SHARDS) -> str:
    """DuckDB SQL of ``assign`` over documents by source: every sum of consecutive groups is tried as a capacity."""
    return f"""
WITH RECURSIVE g AS (SELECT source AS grp, sum(coalesce(strlen(text), 0))::BIGINT AS size, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM documents GROUP BY source),
p AS (SELECT i, grp, size, sum(size) OVER (ORDER BY i)::BIGINT AS upto FROM g),
c AS (SELECT DISTINCT b.upto - a.upto + a.size AS cap FROM p a JOIN p b ON b.i >= a.i WHERE b.upto - a.upto + a.size >= (SELECT max(size) FROM p)),
walk AS (
  SELECT cap, 0::BIGINT AS i, 0 AS shard, 0::BIGINT AS used FROM c
  UNION ALL
  SELECT cap, p.i, CASE WHEN used + size <= cap THEN shard ELSE shard + 1 END, CASE WHEN used + size <= cap THEN used + size ELSE size END
  FROM walk JOIN p ON p.i = walk.i + 1),
fit AS (SELECT cap FROM walk GROUP BY cap HAVING max(shard) < {shards}),
chosen AS (SELECT i, shard FROM walk WHERE cap = (SELECT min(cap) FROM fit) AND i > 0)
SELECT doc_id, source AS grp, shard::INTEGER AS shard FROM documents JOIN p ON documents.source IS NOT DISTINCT FROM p.grp JOIN chosen USING (i)"""
