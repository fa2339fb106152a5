from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.llm import decontam, textvec


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.expovariate(0.02)), 400)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30))) + ". " + " ".join(word() for _ in range(6)) + ".") for i in range(30)]
    docs = []
    for i in range(120):
        w = [word() for _ in range(rng.randint(0, 400))]
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = items[i // 4][1].split()
        elif i % 4 == 1:  # the question alone, half of it
            w += items[i // 4][1].split()[:5]
        docs.append((i, " ".join(w)))
    return docs, items


def test_search_equals_exhaustive_scoring():
    docs, items = corpus()
    ix = decontam.Index(items)
    texts = pa.array([t for _, t in docs])
    got = {}
    for lo, _, buf, off in textvec.slices(texts):
        for r, p, i, s in zip(*ix.search(*textvec.words(buf, off))):
            got[lo + int(r), int(p), ix.ids[int(i)]] = float(s)
    bags = {i: t.replace(".", "").split() for i, t in items}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags)
    df = Counter(t for w in bags.values() for t in set(w))
    weight = {}
    for i, w in bags.items():
        one = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in Counter(w).items()}
        weight[i] = {t: x / sum(one.values()) for t, x in one.items()}
    want = {}
    for d, text in docs:
        w = text.replace(".", "").split()
        for p in range(-(-len(w) // ix.stride)):
            seen = set(w[p * ix.stride : (p + 2) * ix.stride])
            for i, ws in weight.items():
                s = sum(x for t, x in ws.items() if t in seen)
                if s >= decontam.RETRIEVE - 1e-9:
                    want[d, p, i] = s
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_hits_and_clean(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.hits(d, b).collect()}
    assert got == {(i, i // 4) for i in range(0, 120, 4)}
    left = decontam.clean(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {i for i in range(120) if i % 4}


def test_several_passes_give_the_same_hits(spark, monkeypatch):
    docs, items = corpus()
    long = " ".join(f"l{i % 90}" for i in range(300)) + ". the long answer."
    items += [(100, long), (101, long + " tail of it")]
    docs += [(500, "before " * 70 + long + " after" * 70), (501, long)]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(tuple(r) for r in decontam.hits(d, b).collect())
    assert {(r[0], r[1]) for r in want} >= {(500, 100), (501, 100)}
    monkeypatch.setattr(decontam, "INDEX_BYTES", 100)
    passes = list(decontam.indexes(b))
    assert len(passes) > 10 and sum(ix.n for p in passes for ix in p) == 32
    assert sorted(tuple(r) for r in decontam.hits(d, b).collect()) == want
    assert decontam.clean(d, b).count() == d.count() - len({r[0] for r in want})


def test_long_items_leave_the_passages_of_short_ones_alone(spark):
    docs, items = corpus()
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    one = spark.createDataFrame([(900, "x1 " * 8000 + "y.")], "item_id long, text string")
    with_long = {(r.doc_id, r.item_id, r.passage) for r in decontam.hits(d, b.unionByName(one)).collect()}
    assert with_long == {(r.doc_id, r.item_id, r.passage) for r in decontam.hits(d, b).collect()}


def test_bounded_arrays(monkeypatch):
    docs, items = corpus(4)
    ix = decontam.Index(items)
    _, _, buf, off = next(textvec.slices(pa.array([t for _, t in docs])))
    want = [x.tolist() for x in ix.search(*textvec.words(buf, off))]
    monkeypatch.setattr(decontam, "CELLS", 7)
    assert [x.tolist() for x in ix.search(*textvec.words(buf, off))] == want


def test_awkward_rows(spark):
    item = "what is the name of the old river. it is called blue water."
    d = spark.createDataFrame([(None, item), (1, None), (2, ""), (3, item), (3, item), (4, "x " * 100_000 + item)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (None, "another thing to ask about. it is here."), (8, None), (9, "")], "item_id long, text string")
    got = decontam.hits(d, b)
    assert sorted((r.doc_id or 0, r.item_id) for r in got.collect()) == [(0, 7), (3, 7), (3, 7), (4, 7)]
    assert sorted(r.doc_id for r in decontam.clean(d, b).collect()) == [1, 2]
    assert decontam.hits(d, b.limit(0)).count() == 0
    assert decontam.hits(d.limit(0), b).count() == 0
    assert decontam.clean(d, b.limit(0)).count() == 6


def test_split_and_grams():
    assert decontam.split_item("A b? C d.") == ("A b?", "C d.")
    assert decontam.split_item("one two three four") == ("one two three", "four")
    assert len(decontam.grams(np.arange(5))) == 3
    assert len(decontam.grams(np.arange(2))) == 2


def test_equals_sql(spark):
    docs, items = corpus(9)
    items[3] = (3, items[3][1].split(". ")[0])  # one sentence
    items.append((40, " ".join(f"l{i % 70}" for i in range(130)) + ". the long answer."))
    docs.append((600, "before " * 70 + items[-1][1] + " after" * 70))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = con.execute(decontam.sql()).df().sort_values(["doc_id", "item_id"])
    got = decontam.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).toPandas().sort_values(["doc_id", "item_id"])
    assert got.to_numpy().tolist() == want[got.columns].to_numpy().tolist()
    assert len(got) >= 29
