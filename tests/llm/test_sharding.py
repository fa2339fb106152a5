from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import sharding


def brute(sizes, k):
    """Least largest sum of k consecutive parts, by dynamic programming."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    best = upto.astype(float)
    for _ in range(k - 1):
        best = np.array([min(max(best[j], upto[i] - upto[j]) for j in range(i + 1)) for i in range(len(upto))])
    return int(best[-1])


@pytest.mark.parametrize("seed", range(15))
def test_capacity_is_minimal(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.choice([0, 1, 5, 100, rng.randint(0, 50)]) for _ in range(rng.randint(1, 40))])
    k = rng.randint(1, 6)
    n = 7
    blocks = [sizes[i : i + n] for i in range(0, len(sizes), n)]
    s = sharding.Sizes(np.array([b.sum() for b in blocks]), np.array([len(b) for b in blocks]), lambda which: {i: blocks[i] for i in which})
    got, cuts = sharding.smallest_capacity(s, int(sizes.max()), k)
    assert got == brute(sizes, k)
    parts = np.split(sizes, cuts)
    assert len(parts) <= k
    assert max(p.sum() for p in parts) <= got


def test_assign_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 5)
    rng = random.Random(2)
    rows = [(i, f"g{rng.randint(0, 39):02d}", "x" * rng.randint(0, 30)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sharding.assign(d, shards=6).toPandas()
    by = {}
    for i, g, t in rows:
        by[g] = by.get(g, 0) + len(t)
    used = got.merge(d.toPandas(), on="doc_id")
    assert used.groupby("grp")["shard"].nunique().max() == 1
    load = used.assign(n=used.text.str.len()).groupby("shard").n.sum()
    assert load.max() == brute([by[g] for g in sorted(by)], 6)
    order = used.groupby("shard").grp.agg(["min", "max"]).sort_index()
    assert (order["max"].iloc[:-1].to_numpy() < order["min"].iloc[1:].to_numpy()).all()


def test_awkward_rows(spark):
    d = spark.createDataFrame([(1, None, "aaa"), (2, "b", None), (2, "b", "x"), (None, "c", "é" * 4), (3, "d", "y" * 300_000)], "doc_id long, source string, text string").withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash"))
    got = sorted(((r.doc_id or 0, r.grp, r.shard) for r in sharding.assign(d, shards=3).collect()), key=str)
    assert len(got) == 5
    assert [g[2] for g in got if g[1] is None] == [0]
    assert len({g[2] for g in got if g[1] == "b"}) == 1
    assert {r.shard for r in sharding.assign(d, shards=1).collect()} == {0}
    assert sharding.assign(d.limit(0)).count() == 0
