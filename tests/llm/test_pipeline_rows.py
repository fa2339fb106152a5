"""The stages on odd rows, and the whole pipeline against its parts done by brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import packing, quality, simhash, toxicity
from inkwell.llm.common import load
from tests.llm.test_packing import brute as brute_packing
from tests.llm.test_simhash import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def good(spark):
    """Texts that the first stages keep."""
    docs = load(spark, SF, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF)
    return [r.text for r in kept.orderBy("doc_id").limit(8).collect()]


def odd(spark, good):
    rows = [(1, good[0]), (1, good[0]), (2, good[0]), (None, good[1]), (3, None), (4, ""), (5, " .. "), (6, good[2]), (6, good[3]), (7, " ".join(good) * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("q_words_", "score", "fp", "node", "rank_", "seed", "n", "label_", "shard", "row_")
    return df.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(names)], F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"))


@pytest.mark.parametrize("k", range(5))
def test_each_stage_alone(spark, good, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd(spark, good)
    out = stage(spark, docs, SF)
    if name == "packing":
        placed = [d for r in out.collect() for d in r.doc_ids]
        assert set(placed) == {1, 2, 6, 7} and placed.count(1) == placed.count(6) == 2
        assert stage(spark, docs.limit(0), SF).count() == 0
        return
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = sorted((r.doc_id or 0) for r in out.collect())
    nulls = {"quality": [0, 1, 1, 2, 6, 6], "near_duplicates": [0, 1, 3, 4, 5, 6, 7]}
    want = nulls.get(name, [0, 1, 1, 2, 3, 4, 5, 6, 6, 7])
    free = (5, 7) if name == "quality" else (7,)  # the model decides about these
    assert [x for x in kept if x not in free] == [x for x in want if x not in free]
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_whole_pipeline_equals_its_parts_by_brute_force(spark):
    docs = load(spark, SF, "documents")
    labels = load(spark, SF, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, labels)
    stats = quality.with_stats(docs, "text").select("doc_id", *quality.STATS).toPandas()
    odds = model.log_odds(stats[list(quality.STATS)].to_numpy())
    left = {d for d, z, n in zip(stats.doc_id, odds, stats.n_words) if n > 0 and 1 / (1 + np.exp(-z)) >= model.threshold}
    toxic = toxicity.train(docs, labels)
    weight = dict(zip(toxic.terms.tolist(), toxic.weights.tolist()))
    left = {d for d in left if _noisy_or(texts[d].lower(), weight, toxic.bias) < toxic.threshold}
    sig = simhash.signatures(docs.where(F.col("doc_id").isin(sorted(left)))).toPandas()
    fps = np.frombuffer(b"".join(sig.fp), np.uint64).reshape(-1, simhash.PARTS)
    left -= {d for d, _ in brute_groups(sig.doc_id.tolist(), fps, simhash.ACCEPT)}
    left -= _contaminated({d: texts[d] for d in left}, [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()])
    want = brute_packing(sorted((d, texts[d]) for d in left), packing.WINDOW, packing.ONE_IN, pattern=WORD)
    got = {(r.seed_doc_id, r.piece, r.window): list(r.doc_ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


WORD = "[a-z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-῿⁰-⿿぀-\U0010ffff]+"


def _noisy_or(text, weight, bias):
    import math
    import re

    from inkwell.llm import textvec as tv

    def features(w):
        raw = w.encode()
        yield tv.term_of(w)
        for n in toxicity.STEMS:
            if len(raw) > n:
                h = tv.span_hash(tv.prefix_hash(np.frombuffer(raw, np.uint8)), np.array([0]), np.array([n]))
                yield int(tv.mix(h + np.uint64(n))[0] >> np.uint64(64 - tv.TERM_BITS))

    clean = 1.0
    for sentence in re.split(r"[.!?\n\r]", text):
        got = [weight[f] for w in re.findall(WORD, sentence) for f in features(w) if f in weight]
        if got:
            clean *= 1 - 1 / (1 + math.exp(-max(-50, min(50, sum(got) + bias))))
    return 1 - clean


def _contaminated(docs, items):
    """By DuckDB, every passage against every item."""
    import duckdb
    import pandas as pd

    from inkwell.llm import decontam

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(sorted(docs.items()), columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    return set(con.execute(f"SELECT DISTINCT doc_id FROM ({decontam.sql()})").df()["doc_id"].tolist())
