from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkwell.llm import postings, topk
from inkwell.llm import textvec as tv


def sql_result(docs, items, k=topk.K):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    return sorted(map(tuple, con.execute(topk.sql(k=k, queries="SELECT item_id AS query_id, text FROM benchmark")).fetchall()))


def test_equals_sql_with_ties(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{min(int(rng.expovariate(0.05)), 80)}" for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(200)]
    docs += [(200 + i, docs[0][1]) for i in range(30)]  # ties
    items = [(i, text(8)) for i in range(12)]
    got = topk.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "query_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sql_result(docs, items)


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(postings, "QUERY_BYTES", 3)
    docs = [(i, f"a b{i}") for i in range(5)]
    items = [(1, "b1 b2"), (2, "a"), (3, "b4")]
    got = topk.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, text string"), 2)
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 0), (2, 2, 1), (3, 1, 4)]


def test_awkward_rows(spark):
    d = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "a " * 50_000)], "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("q", F.lit("x"))
    q = spark.createDataFrame([(7, "a"), (None, "b"), (8, None), (9, "")], "query_id long, text string")
    got = sorted((r.query_id or 0, r.rank, r.doc_id) for r in topk.search(d, q).collect())
    assert got == [(0, 1, 3), (0, 2, 3), (7, 1, 4), (7, 2, 3), (7, 3, 3)]
    assert topk.search(d.limit(0), q).count() == 0
    assert topk.search(d, q.limit(0)).count() == 0


def test_best():
    assert topk.best(np.array([0, 3, 1, 3, 2]), np.array([9, 8, 7, 6, 5]), 2).tolist() == [3, 1]
    assert topk.best(np.zeros(3), np.arange(3), 2).tolist() == []


def test_many_shards_and_large_frequencies(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 5, 20])))) for i in range(60)] + [(60, "a " * 300 + "b")]
    items = [(1, "a a b"), (2, "c h"), (3, "zz")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "query_id long, text string")
    assert postings.build(d).df.count() > 3  # a shard or more a task
    assert sorted(tuple(r) for r in topk.search(d, q, 5).collect()) == sorted(map(tuple, sql_result(docs, items, 5)))


def test_dense_rows_and_double_precision_give_the_same_sums():
    rng = np.random.default_rng(2)
    words = [[f"w{min(int(x), 60)}" for x in rng.exponential(8, rng.integers(1, 60))] for _ in range(300)]
    words[0] = ["w1"] * 40_000  # weights past single precision
    block = postings.Block([(i, " ".join(w)) for i, w in enumerate(words[:50])])
    size = np.array([len(w) for w in words])
    flat = postings.short(np.array([tv.term_of(x) for w in words for x in w]))
    row = tuple(x.astype(kind).tobytes() for x, kind in zip(postings._shard(np.arange(300), flat, size), postings._ARRAYS.values()))
    idf = rng.random(len(block.vocab)) * 20
    shard = postings.Shard(row, block, idf, 30.0)
    assert 0 < len(shard.rows) < len(block.vocab)
    for counted in (True, False):
        for i, score in shard.scores(block, counted):
            lo, hi = block.at[i], block.at[i + 1]
            want = np.zeros(300)
            for t, n in zip(block.term[lo:hi], block.qtf[lo:hi]):
                tf = np.bincount(np.repeat(np.arange(300), size)[flat == block.vocab[t]], minlength=300)
                want += np.floor(1000 * (idf[t] * postings.part(tf.astype(float), size, 30.0))) * (n if counted else 1)
            assert (score == want).all()
