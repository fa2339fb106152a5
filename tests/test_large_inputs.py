"""Queries whose cost must not grow faster than the input: same results, and what their plans hold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import lexicon
from inkwell.operators.index import TextIndex, fresh_path, postings, sections
from inkwell.operators.select import select
from inkwell.operators.tokenize import Tokenizer, token_rows
from inkwell.streaming import ingest

ODD = ["a b\ta　b\x1cc\xa0d", "", None, "  ", "é É ü", "ｶﾞ ½ ﬁ İ\x01x", "x" * 50]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "k long, t string")


def test_token_rows(spark, docs):
    how = Tokenizer("ngram", normalize=True)
    want = [(k, t, p) for k, s in enumerate(ODD) if s is not None for t, p in how.tokens(s)]
    got = token_rows(docs, "k", "t", how)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "ArrowEvalPython" not in plan(got)  # which would hold all tokens of a batch of rows


def test_postings_need_no_shuffle(spark, docs):
    got = postings(sections(docs, "k", ["t"]), Tokenizer())
    assert "Aggregate" not in plan(got)
    want = {(t, k): [p for u, p in Tokenizer().tokens(s) if u == t] for k, s in enumerate(ODD) if s for t, _ in Tokenizer().tokens(s)}
    assert {(r.term, r.rid): r.positions for r in got.collect()} == want


def test_postings_of_repeated_and_missing_keys(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "b"), (None, "a"), (None, "c a"), (2, "a")], "k long, t string")
    got = postings(sections(rows, "k", ["t"], [3]), Tokenizer())
    assert sorted(((r.term, r.rid or 0, r.tf, r.wsum, r.positions) for r in got.collect())) == [
        ("a", 0, 2, 6, [0, 1]), ("a", 1, 1, 3, [0]), ("a", 2, 1, 3, [0]), ("b", 1, 2, 6, [0, 1]), ("c", 0, 1, 3, [0])]


def test_deltas_move_no_postings(spark, docs):
    ix = TextIndex.of_columns(docs, "k", ["t"]).save(fresh_path(spark))
    ix = ix.upsert(sections(docs.where("k = 0").withColumn("t", F.lit("new")), "k", ["t"])).delete(docs.where("k = 4").select(F.col("k").alias("rid")))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" not in plan(ix.postings)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {r.rid for r in ix.compact().postings.collect()} == {0, 5, 6}


def test_stream_sections_need_no_join(spark, docs):
    got = ingest._all_sections(docs, "k", ["t"])
    assert "Join" not in plan(got)
    assert {r.rid: [v.str for v in r["values"]] for r in got.collect()} == {k: [] if s is None else [s] for k, s in enumerate(ODD)}


def test_partial_phrase_is_one_aggregation(spark):
    rows = spark.createDataFrame([(1, "of the of tha"), (2, "of of"), (3, "the of")], "k long, t string")
    got = select(TextIndex.of_columns(rows, "k", ["t"]), "of th", "partial").df
    assert "distinct" not in plan(got)
    assert {r.rid: r.score for r in got.collect()} == {1: 2}


def test_fast_normalisation():
    rnd = random.Random(5)
    alpha = [*"aAbé’“œß½ﬁＡ　゛か゜ﾊﾟ한글́̈İΣ漢 \n\t\x01", "thing", "tion of"]
    few = lexicon._Trie(["thing", "a", "ab", "é", "tion of", "が"])
    seen = 0
    for _ in range(3000):
        s = "".join(rnd.choices(alpha, k=rnd.randrange(1, 12)))
        want = "".join(T.normalize_with_offsets(s)[0])
        fast = T.mapped_apart(s)
        seen += fast is not None and not s.isascii()
        assert fast in (None, want) and T.normalize(s) == want
        for normalized in (True, False):
            by_pattern, few.pattern, kept = few.scan(s, normalized), None, few.pattern
            assert by_pattern == few.scan(s, normalized), s
            few.pattern = kept
    assert seen > 100
