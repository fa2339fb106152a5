from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import langid, textvec


def total(word: bytes, names, starts, prob):
    """Sum over all segmentations, by recursion."""
    inner = {n: p for n, s, p in zip(names, starts, prob) if not s}
    first = {n: p for n, s, p in zip(names, starts, prob) if s}

    def rest(i):
        if i == len(word):
            return 1.0
        out = 0.0
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in inner:
                out += inner[word[i:j]] * rest(j)
            if len(word[i:j].decode("utf-8", "ignore")) == 1 and len(word[i:j].decode("utf-8", "ignore").encode()) == j - i:
                out += langid.UNKNOWN * rest(j)
        return out

    return first.get(b"", 1.0) * rest(0) + sum(p * rest(len(n)) for n, p in first.items() if n and word.startswith(n))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    names = [b"", b"a", b"ab", b"b", b"ba", "é".encode(), "aé".encode(), b"a", b"ab"]
    starts = [True, False, False, False, False, False, False, True, True]
    prob = rng.random((2, len(names)))
    table = langid.Pieces(names, starts)
    words = ["a", "ab", "abab", "aéb", "zab", "baéa", "éé"]
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    lens = np.array([len(w) for w in raw])
    at = np.cumsum(lens) - lens
    spans = table.spans(textvec.prefix_hash(buf), buf, at, lens)
    alpha = table.forward(spans, prob, len(words))[0]
    beta = table.backward(spans, prob, lens)
    for k, w in enumerate(raw):
        for lang in range(2):
            want = total(w, names, starts, prob[lang])
            assert alpha[lens[k], k, lang] == pytest.approx(want)
    whole = words.index("abab")
    assert beta[0, whole, 0] > 0


def by_prefix(word: bytes, names, starts, prob):
    """Logarithm of the sum over all segmentations, prefix by prefix, in decimals with a wide exponent."""
    inner = {n: Decimal(float(p)) for n, s, p in zip(names, starts, prob) if not s}
    first = {n: Decimal(float(p)) for n, s, p in zip(names, starts, prob) if s}
    sums = [first.get(b"", Decimal(1))]
    for j in range(1, len(word) + 1):
        got = Decimal(0)
        for i in range(max(0, j - 5), j):
            piece = word[i:j]
            got += sums[i] * inner.get(piece, 0)
            if len(piece.decode("utf-8", "ignore")) == 1 and len(piece.decode("utf-8", "ignore").encode()) == len(piece):
                got += sums[i] * Decimal(langid.UNKNOWN)
        sums.append(got + (first.get(word[:j], 0) if j < 6 else 0))
    return float(sums[-1].ln())


def test_long_words_are_summed_whole():
    rng = np.random.default_rng(1)
    names = [b"", b"a", b"ab", b"b", b"ba", "é".encode(), "aé".encode(), b"a", b"ab"]
    starts = [True, False, False, False, False, False, False, True, True]
    prob = np.stack([rng.random(len(names)) * 1e-7, rng.random(len(names)) * 1e-5, rng.random(len(names)) * 1e-5])
    model = langid.Model(["p", "q", "r"], prob, langid.Pieces(names, starts))
    for n in (5, 30, 33, 40, 64, 65, 200, 700, 1000, 1300, 3000):
        word = "".join(rng.choice(["a", "b", "é", "z"], n)).encode()
        buf = np.frombuffer(word, np.uint8)
        got = model.scores(buf, np.array([0, len(buf)]))[0][0]
        for k in range(3):
            assert got[k] == pytest.approx(by_prefix(word, names, starts, prob[k]), rel=1e-9), n


def test_words_of_many_lengths_at_once():
    rng = np.random.default_rng(4)
    names, starts = [b"", b"a", b"ab", b"b", b"ba", b"a"], [True, False, False, False, False, True]
    prob = rng.random((2, len(names)))
    model = langid.Model(["p", "q"], prob, langid.Pieces(names, starts))
    words = ["".join(rng.choice(["a", "b", "c"], n)) for n in rng.integers(1, 1500, 120)]
    buf = np.frombuffer(" ".join(words).encode(), np.uint8)
    alone = sum(model.scores(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in words)
    assert model.scores(buf, np.array([0, len(buf)]))[0][0] == pytest.approx(alone)


def test_scripts_without_spaces(spark):
    rng = np.random.default_rng(6)
    kana, han = [chr(c) for c in range(0x3042, 0x3080)], [chr(c) for c in range(0x4E00, 0x4E60)]
    text = lambda chars: "".join(rng.choice(chars, 150)) + "。" + "".join(rng.choice(chars, 3000))
    d = spark.createDataFrame([(i, text(kana if i % 2 else han), "ja" if i % 2 else "zh") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.train(d.where("doc_id < 10"))
    assert langid.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").where("language = lang").count() == 20


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where("doc_id % 3 = 0"))
    test = docs.where("doc_id % 3 <> 0")
    right = langid.identify(test, model).join(test.select("doc_id", "lang"), "doc_id").where("language = lang").count()
    assert right / test.count() > 0.98


def test_training_raises_likelihood():
    texts = pa.array(["the thing and then the other", "there they think that"])
    buf = np.frombuffer(b"the thing then", np.uint8)
    one, more = (langid.fit(texts, ["x", "x"], rounds=r).scores(buf, np.array([0, len(buf)]))[0][0, 0] for r in (1, 5))
    assert more > one


def test_awkward_rows(spark):
    d = spark.createDataFrame([(1, "the thing", "en"), (1, "the thing", "en"), (None, "das ding und", "de"), (2, None, "en"), (3, "", None), (4, "12 !?", "en"), (5, "der die das " * 30_000, "de"), (6, "x" * 5000 + " é" * 10, "de"), (7, "und der das", "de")], "doc_id long, text string, lang string")
    d = d.withColumn("language", F.lit("clash"))
    model = langid.train(d)
    rows = langid.identify(d, model).collect()
    assert len(rows) == 9
    by = {r.doc_id: r.language for r in rows}
    assert (by[1], by[5], by[2], by[3]) == ("en", "de", None, None)
    assert langid.identify(d.limit(0), model).count() == 0
    none = langid.train(d.limit(0))
    assert {r.language for r in langid.identify(d, none).collect()} == {None}
