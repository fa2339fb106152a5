from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import simhash


def pairs_at(distance, n, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, (n, simhash.PARTS), dtype=np.uint64)
    b = a.copy()
    for i in range(n):
        for bit in rng.choice(64 * simhash.PARTS, distance, replace=False):
            b[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return a, b


@pytest.mark.parametrize("words,rho", simhash.COVERS)
def test_pairs_within_the_radius_always_meet(words, rho):
    cover = simhash.Cover(words, rho)
    assert cover.radius >= simhash.ACCEPT
    assert sum(len(m) for _, _, m in cover.units) == cover.tables
    for distance in (*range(0, simhash.ACCEPT, 4), simhash.ACCEPT):
        a, b = pairs_at(distance, 60, distance)
        met = np.zeros(60, bool)
        for p, shared, masks in cover.units:
            x, y = cover.word(a, p), cover.word(b, p)
            for m in masks:
                assert m & shared == shared
                met |= (x & m) == (y & m)
        assert met.all()


def test_words_of_a_cover_hold_each_bit_once():
    fps = np.random.default_rng(0).integers(0, 2**64, (50, simhash.PARTS), dtype=np.uint64)
    for words, rho in simhash.COVERS:
        cover = simhash.Cover(words, rho)
        assert sum(np.bitwise_count(cover.word(fps, p)) for p in range(words)).tolist() == np.bitwise_count(fps).sum(axis=1).tolist()


def test_choice_of_the_cover():
    assert {simhash.choose(10**k).radius >= simhash.ACCEPT for k in range(12)} == {True}
    assert simhash.choose(1000).tables < simhash.choose(10**9).tables
    with pytest.raises(ValueError):
        simhash.choose(5, 200)


@pytest.mark.parametrize("cover", [(8, 4, 3), (7, 5, 2), (5, 7, 1)])
def test_links_at_every_distance(spark, cover):
    rows = []
    for distance in range(0, simhash.ACCEPT + 6):
        a, b = pairs_at(distance, 4, 100 + distance)
        rows += [(bytes(x.tobytes()), bytes(y.tobytes()), distance) for x, y in zip(a, b)]
    every = np.frombuffer(b"".join(x for r in rows for x in r[:2]), np.uint64).reshape(-1, simhash.PARTS)
    names = simhash.node_ids(every)
    want = {(min(int(names[2 * i]), int(names[2 * i + 1])), max(int(names[2 * i]), int(names[2 * i + 1]))) for i, r in enumerate(rows) if 0 < r[2] <= simhash.ACCEPT}
    df = spark.createDataFrame([(x,) for x in {x for r in rows for x in r[:2]}], "fp binary").repartition(3)
    assert {tuple(r) for r in simhash.edges(df, cover=simhash.Cover(*cover)).collect()} == want


def brute_groups(ids, fps, reach):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(simhash.distance(fps[i + 1 :], fps[i]) <= reach):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(d, low.get(find(i), d))
    return {(d, low[find(i)]) for i, d in enumerate(ids) if d != low[find(i)]}


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 200"))
    sig = simhash.signatures(docs).toPandas()
    fps = np.frombuffer(b"".join(sig.fp), np.uint64).reshape(-1, simhash.PARTS)
    for accept in (12, simhash.ACCEPT):
        got = {tuple(r) for r in simhash.duplicates(docs, accept).collect()}
        assert got == brute_groups(sig.doc_id.tolist(), fps, accept)
    assert got == {tuple(r) for r in simhash.duplicates(docs, cover=simhash.Cover(6, 6)).collect()}


def test_cluster_walks_chains():
    fps = np.zeros((60, 1), np.uint64)
    for i in range(60):
        fps[i, 0] = np.uint64((1 << i) - 1)
    assert len(set(simhash._cluster(fps, 1).tolist())) == 1
    assert len(set(simhash._cluster(fps[::2], 1).tolist())) == 30
    a, b = simhash.links(np.repeat(fps, simhash.PARTS, axis=1), np.zeros(60, np.uint64), simhash.PARTS)
    assert len(a) == 59


def test_long_runs_and_forests(monkeypatch):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, (40, simhash.PARTS), dtype=np.uint64)[rng.integers(0, 40, 500)]
    fps[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    key = rng.integers(0, 3, 500).astype(np.uint64)

    def parts(a, b):
        x, y = simhash.forest(a, b)
        return dict(zip(y.tolist(), x.tolist()))

    want = [(i, j) for i in range(500) for j in range(i) if key[i] == key[j] and simhash.distance(fps[i], fps[j]) <= 8]
    want = parts(np.array([x for x, _ in want]), np.array([y for _, y in want]))
    assert parts(*simhash.links(fps, key, 8)) == want
    monkeypatch.setattr(simhash, "_ALL_PAIRS", 50)
    assert parts(*simhash.links(fps, key, 8)) == want
    monkeypatch.setattr(simhash, "_ALL_PAIRS", 2048)
    monkeypatch.setattr(simhash, "_REDUCE", 3)
    assert parts(*simhash.links(fps, key, 8)) == want


def test_an_id_with_several_texts_stands_for_all_of_them(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    d = spark.createDataFrame([(5, a), (7, a), (5, b), (3, b), (9, "else")], "doc_id long, text string")
    assert {tuple(r) for r in simhash.duplicates(d).collect()} == {(5, 3), (7, 3)}
    assert sorted(r.doc_id for r in simhash.dedup(d).collect()) == [3, 9]


def test_scripts_without_spaces(spark):
    rng = random.Random(2)
    text = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(400))
    near = text[:200] + "新" + text[201:]
    other = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(400))
    d = spark.createDataFrame([(1, text), (2, near), (3, other)], "doc_id long, text string")
    assert {tuple(r) for r in simhash.duplicates(d).collect()} == {(2, 1)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {(r.node, r.root) for r in simhash.components(spark.createDataFrame([(min(x), max(x)) for x in chain], "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(101, 100), (102, 100)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    near = base.copy()
    near[5] = "other"
    rows = [(10, " ".join(base)), (10, " ".join(base)), (11, " ".join(near)), (None, " ".join(base)), (1, None), (2, ""), (3, "!!"), (4, " ".join(f"z{i}" for i in range(60_000)))]
    rows += [(1000 + i, "the very same copy") for i in range(1500)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string").withColumn("node", F.lit(1))
    got = {(r.doc_id, r.duplicate_of) for r in simhash.duplicates(d).collect()}
    assert got == {(11, 10)} | {(1000 + i, 1000) for i in range(1, 1500)}
    kept = simhash.dedup(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 10, 1000]
    assert simhash.duplicates(d.limit(0)).count() == 0
    assert simhash.dedup(d.limit(0)).count() == 0


def test_fingerprints_of_empty_texts():
    fps, has = simhash.fingerprints(pa.array(["", "a b", " "]))
    assert has.tolist() == [False, True, False]
    assert fps.shape == (3, simhash.PARTS)
