from __future__ import annotations

import math
import re

import numpy as np
import regex
from pyspark.sql import functions as F

from inkwell.llm import quality


def test_compiled_rules_equal_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    model = quality.train(docs, train)
    got = quality.scored(docs, model).toPandas().set_index("doc_id")
    stats = quality.with_stats(docs, "text").select("doc_id", *quality.STATS).toPandas().set_index("doc_id")
    p = 1 / (1 + np.exp(-model.log_odds(stats[list(quality.STATS)].to_numpy())))
    assert np.allclose(got.loc[stats.index, "quality_score"], p)
    held = test.toPandas().set_index("doc_id").join(got)
    assert (held.accepted == (held.quality == 1)).mean() > 0.95
    assert 0 < len(model.rules) < 200


def test_lasso_is_sparse_and_finds_the_rule():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(quality.STATS)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] < 0.6)).astype(float)
    m = quality.fit(x, y)
    right = ((m.log_odds(x) > np.log(m.threshold / (1 - m.threshold))) == (y > 0)).mean()
    assert right > 0.97
    heaviest = max(m.rules, key=lambda r: abs(r.weight))
    assert {f for f, _, _ in heaviest.tests} & {2, 4}


def brute_stats(text: str | None) -> list[float]:
    t = text or ""
    w = [x for x in re.split("[ \n\r\t]+", t) if x]
    n, chars = max(len(w), 1), max(len(t), 1)
    count = lambda pattern: len(regex.findall(pattern, t))
    return [len(w), chars / n, len(set(w)) / n, count(r"[#$%&*|!<>{}=_~^\\]") / n, count(r"\p{Lu}") / chars, count("[0-9]") / chars, count("[.?]") / n, count("\n") / n]


def test_scores_equal_brute_force(spark):
    """Statistics, rules and the verdict, a text at a time in plain Python."""
    texts = ["", None, " \n", "One two two.", "ÄÖ ab 12 # <b> x_y\nnew line? yes.", "a\\b ~^ " * 50, "日本 語 é é", "A" * 5000, "One two two."]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1 - i, t) for i, t in enumerate(texts)]
    want = []
    for i, t in rows:
        x = brute_stats(t)
        z = model.bias
        for rule in model.rules:
            if all((x[f] > cut) == above for f, above, cut in rule.tests):
                z += rule.weight
        score = 1 / (1 + math.exp(-z)) if x[0] else 0.0
        want.append((i, score, score >= model.threshold))
    got = {r.doc_id: r for r in quality.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert len(got) == len(rows)
    for i, score, ok in want:
        assert math.isclose(got[i].quality_score, score, abs_tol=1e-9)
        assert got[i].accepted == ok


def test_lasso_reaches_the_optimum():
    """The subgradient conditions of the penalised loss, which only its minimum meets."""
    rng = np.random.default_rng(3)
    d = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * d[:, 0] - 3 * d[:, 1])))).astype(float)
    for l1 in (3e-2, 1e-2, 3e-3):
        w, b = quality._lasso(d, y, l1, rounds=4000)
        r = 1 / (1 + np.exp(-(d @ w + b))) - y
        g = d.T @ r / len(y)
        assert abs(r.mean()) < 1e-4
        assert np.allclose(g[w != 0], -l1 * np.sign(w[w != 0]), atol=1e-4)
        assert (np.abs(g[w == 0]) <= l1 + 1e-4).all()


def test_degenerate_labels():
    x = np.zeros((20, len(quality.STATS)))
    assert quality.fit(x, np.ones(20)).rules == []
    assert quality.fit(x[:0], np.zeros(0)).rules == []
    assert quality.fit(x, np.arange(20) % 2).rules == []


def test_awkward_rows(spark):
    d = spark.createDataFrame([(1, "a good text. really", 1), (1, "a good text. really", 1), (None, "some text", 1), (2, None, 1), (3, "", 1), (4, " \n", 1), (5, "word " * 200_000, 1)], "doc_id long, text string, n_words int")
    d = d.withColumn("q_n_words", F.lit("clash")).withColumn("words_", F.lit("clash"))
    m = quality.Model(0.0, 0.5, [quality.Rule(((0, True, 1.0),), 2.0)])
    rows = quality.scored(d, m).collect()
    assert len(rows) == 7
    assert {r.doc_id: r.accepted for r in rows} == {1: True, None: True, 2: False, 3: False, 4: False, 5: True}
    kept = quality.accepted(d, m)
    assert kept.columns == d.columns
    assert kept.count() == 4
    empty = quality.train(d.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.scored(d.limit(0), empty).count() == 0
