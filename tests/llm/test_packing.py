from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import packing, postings, textvec


def brute(docs, window, one_in, piece=packing.PIECE, pattern=r"[a-z0-9]+"):
    """Packing straight from the definition: (seed, piece, window) -> documents."""
    words = [(d, re.findall(pattern, t.lower())) for d, t in docs]
    n, mean = len(words), sum(len(w) for _, w in words) / len(words)
    df = Counter(t for _, w in words for t in set(w))
    least = {}
    for d, t in docs:
        if d % one_in == 0:
            least[d] = min(t, least.get(d, t))
    seeds = {d: set(re.findall(pattern, t.lower())) for d, t in least.items()}

    def impact(t, tf, size):
        return math.floor(1000 * (math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)))))

    def score(q, w):
        tf = Counter(w)
        return sum(impact(t, tf[t], len(w)) for t in q if tf[t])

    own = {s: score(seeds[s], re.findall(pattern, least[s].lower())) for s in seeds}
    lists = defaultdict(list)
    for d, w in words:
        if not w:
            continue
        if d in seeds:
            lists[d].append((0, 0.0, d, len(w)))
            continue
        got = [(score(q, w) / math.sqrt(own[s]), int(packing.draw(np.array([d]), s)[0]), -s) for s, q in seeds.items() if own[s] > 0]
        got = max((g for g in got if g[0] > 0), default=None)
        lists[-got[2] if got else None].append((1, -got[0], d, len(w)) if got else (1, 0.0, d, len(w)))
    out = {}
    for s, rows in lists.items():
        rows.sort()
        for p in range(0, len(rows), piece):
            open_, alone = [], []
            for _, _, d, size in rows[p : p + piece]:
                whole, rest = divmod(size, window)
                alone += [[d]] * whole
                if rest:
                    at = next((o for o in open_ if o[0] >= rest), None)
                    if at is None:
                        open_.append(at := [window, []])
                    at[0] -= rest
                    at[1].append(d)
            for k, w in enumerate([o[1] for o in open_] + alone):
                out[s, p // piece, k] = w
    return out


def packed(df, **how):
    return {(r.seed_doc_id, r.piece, r.window): list(r.doc_ids) for r in packing.pack(df, **how).collect()}


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(n):
        words = rng.sample(vocab, rng.randint(5, 100))
        docs.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 40, 70, 150])))))
    docs += [(n + i, docs[7][1]) for i in range(30)]  # copies, also of seeds
    return docs + [(2 * n + 1, "alone here"), (2 * n + 3, "quite alone"), (n + 20, "repeated id w1 w2")]


def test_equals_brute_force(spark):
    docs = corpus(250)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert packed(df, window=64, one_in=5) == brute(docs, 64, 5)


def test_pieces_and_several_blocks(spark, monkeypatch):
    docs = corpus(120, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs, 50, 40, piece=8)
    assert max(p for _, p, _ in want) > 2
    assert packed(df, window=50, one_in=40, piece=8) == want
    monkeypatch.setattr(postings, "QUERY_BYTES", 50)
    assert packed(df, window=50, one_in=9) == brute(docs, 50, 9)


AWKWARD = [
    (100, "a b c", "en", "x"),
    (100, "a b c", "en", "x"),
    (None, "a b c", "en", "x"),
    (2, None, None, None),
    (200, None, None, None),
    (3, "", "en", "x"),
    (300, "", "en", "x"),
    (4, " .. ", "en", "x"),
    (5, "long " * 20000, None, "x"),
    (6, "a b d é ß 中文", "fr", None),
    (-100, "d e", "fr", None),
]


def test_awkward_rows(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, seed string, shard string").withColumn("n", F.lit(1)).withColumn("score", F.lit("x"))
    got = packing.pack(df).collect()
    placed = Counter()
    for r in got:
        assert len(r.doc_ids) == len(r.starts) == len(r.n_words)
        assert sum(r.n_words) == r.total_words <= packing.WINDOW
        for d, n in zip(r.doc_ids, r.n_words):
            placed[d] += n
    assert placed == {100: 6, 5: 20000, 6: 6, -100: 2}
    assert sorted(s for r in got for d, s in zip(r.doc_ids, r.starts) if d == 5) == [0, 4096, 8192, 12288, 16384]
    assert packing.pack(df.limit(0)).count() == 0
    assert {r.seed_doc_id for r in packing.pack(df.where("doc_id in (5, 6)")).collect()} == {None}


def test_copies_of_seeds_spread(spark):
    docs = [(i, "the very same copy") for i in range(1000)] + [(1001 + 2 * i, f"z{i} q") for i in range(1000)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), window=40, one_in=50).collect()
    held = Counter()
    for r in got:
        if r.seed_doc_id is not None:
            held[r.seed_doc_id] += len(r.doc_ids)
    assert len(held) == 20 and max(held.values()) < 100 and sum(held.values()) == 1000


def test_first_fit():
    at, n = packing.fill(np.array([5, 6, 4, 5, 10, 1]), 10)
    assert at.tolist() == [0, 1, 0, 2, 3, 0] and n == 4
    assert packing.fill(np.array([], np.int64), 10)[1] == 0
    assert packing.fill(np.full(200, 7), 10)[1] == 200


@pytest.mark.parametrize("text", ["", "a", "Ab1 c", "é–x　y", "a b×c"])
def test_words_match_their_pattern(text):
    import pyarrow as pa

    pattern = re.compile("[a-z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-῿⁰-⿿぀-\U0010ffff]+")
    low = text.lower()
    got = [t for _, _, buf, off in textvec.slices(pa.array([low])) for t in textvec.words(buf, off)[0].tolist()]
    assert got == [textvec.term_of(w) for w in pattern.findall(low)]
