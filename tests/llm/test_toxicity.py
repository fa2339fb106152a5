from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from inkwell.llm import toxicity

BAD = ["scum", "vile", "hateful"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = int(i % 4 == 0)
        sentences = [" ".join(f"w{rng.randint(0, 200)}" for _ in range(6)) for _ in range(rng.randint(2, 9))]
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = f"you {rng.choice(BAD)} {sentences[at]}"
        out.append((i, ". ".join(sentences) + ".", toxic))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(600, 1)
    return toxicity.fit(pa.array([t for _, t, _ in rows]), np.array([y for *_, y in rows]))


def test_held_out_accuracy_and_location(spark, model):
    rows = corpus(300, 2)
    got = {r.doc_id: r for r in toxicity.flagged(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), model).collect()}
    assert set(got) == {i for i, _, y in rows if y}
    for i, t, y in rows:
        if y:
            assert any(any(b in t[s.start : s.end] for b in BAD) for s in got[i].sentences)
            assert len(got[i].sentences) == 1
            assert t.split(". ")[got[i].sentences[0].sentence].startswith("you ")


def test_document_score_is_the_noisy_or(model):
    text = "you scum w1. w2 w3. vile w4"
    z = {int(t): w for t, w in zip(model.terms, model.weights)}
    p = 1.0
    for s in text.split(". "):
        known = [z[k] for w in s.split() if (k := toxicity.tv.term_of(w)) in z]
        p *= 1 - 1 / (1 + np.exp(-model.bias - sum(known))) if known else 1
    buf = np.frombuffer(text.encode(), np.uint8)
    got = toxicity.document_scores(buf, np.array([0, len(buf)]), model, model.table())
    assert abs(got[0] - (1 - p)) < 1e-9


def test_awkward_rows(spark, model):
    rows = [(None, "you scum"), (1, None), (2, ""), (3, "you scum"), (3, "you scum"), (4, "w1 w2. w3 w4. " * 30_000), (5, "..!?"), (6, "é 中文。scum you")]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, toxicity string")
    got = sorted((r.doc_id or 0) for r in toxicity.flagged(d, model).collect())
    assert got[:3] == [0, 3, 3]
    assert 4 not in got
    kept = toxicity.clean(d, model)
    assert kept.columns == d.columns
    assert {1, 2, 4, 5} <= {r.doc_id for r in kept.collect()}
    assert toxicity.flagged(d.limit(0), model).count() == 0


def test_training_table(spark):
    rows = corpus(200, 3)
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    m = toxicity.train(d, labels)
    assert {r.doc_id for r in toxicity.flagged(d, m).collect()} == {i for i, _, y in rows if y}
    nothing = toxicity.train(d, labels.limit(0))
    assert toxicity.flagged(d, nothing).count() == 0
