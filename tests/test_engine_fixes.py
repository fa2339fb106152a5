from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.operators.index import TextIndex, fresh_path, sections
from inkwell.operators.select import select
from inkwell.operators.table import Slot, Table
from inkwell.operators.tokenize import run_rows
from inkwell.plans.qcompile import search
from inkwell.sources import store


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a"), (4, "b c c")], "doc_id long, text string")


def found(ix, text="a"):
    return sorted(r.rid for r in select(ix, text).df.collect())


def test_logical_delete_survives_compact(spark, docs):
    path = fresh_path(spark)
    ix = TextIndex.build(sections(docs, "doc_id", ["text"])).save(path)
    ix = ix.mark_deleted(spark.createDataFrame([(1,)], "rid long"))
    assert found(ix) == [1, 2, 3]
    assert found(ix.live()) == [2, 3]
    assert found(TextIndex.open(spark, path).live()) == [2, 3]
    done = ix.compact()
    assert found(done) == found(done.live()) == [2, 3]
    again = done.upsert(sections(docs.where("doc_id = 1"), "doc_id", ["text"]))
    assert found(again.live()) == [1, 2, 3]


def test_logical_delete_in_memory(spark, docs):
    ix = TextIndex.build(sections(docs, "doc_id", ["text"])).mark_deleted(spark.createDataFrame([(3,)], "rid long"))
    assert found(ix.live()) == [1, 2]


def test_many_values_of_a_section(spark):
    rows = spark.range(1).select(F.lit(1).cast("long").alias("rid"), F.lit(1).alias("sid"), F.transform(F.sequence(F.lit(0), F.lit(3000)), lambda i: F.struct(F.concat(F.lit("x y w"), i.cast("string")).alias("str"), F.lit(0).alias("weight"))).alias("values"))
    ix = TextIndex.build(rows)
    assert select(ix, "x y").find(1) == 3001
    assert select(ix, "w3000").find(1) == 1
    assert select(ix, "w7 x").find(1) == 0  # phrases don't cross values


def test_upsert_of_a_repeated_key(spark):
    t = Table("t", spark.createDataFrame([("k", 1), ("m", 2)], "key string, n int"), "key", {"n": Slot("int")})
    out = t.upsert(spark.createDataFrame([("k", 5), ("k", 9), ("new", 3), ("new", 3)], "key string, n int"))
    assert sorted((r.key, r.n) for r in out.df.collect()) == [("k", 9), ("m", 2), ("new", 3)]


def test_queries_of_terms_read_the_postings_once(docs, spark):
    path = fresh_path(spark)
    ix = TextIndex.of_columns(docs, "doc_id", ["text"]).save(path)
    for text, want in (("+a +b", {1: 10}), ("a -b", {2: 5, 3: 5}), ("a (b c)", {1: 5, 2: 5, 3: 5, 4: 15}), ("*D+ a (b c)", {}), ("a +(b c)", {1: 5, 2: 5}), ("c >b", {2: 5, 4: 16}), ("a a", {1: 10, 2: 10, 3: 10})):
        got = search(ix, text)
        assert {r.rid: r.score for r in got.df.collect()} == want, text
        if not want:  # later stages were tried too
            continue
        plan = got.df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") <= (2 if "(b c)" in text else 1), text
    plan = search(ix, "+a +b").df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(term" in plan


def test_runs(spark):
    df = spark.createDataFrame([(1, "Ab12 ,.c"), (2, None), (3, "")], "k long, t string")
    assert sorted((r.k, r.term, r.pos) for r in run_rows(df, "k", "t").collect()) == [(1, ",.", 4), (1, "12", 2), (1, "ab", 0), (1, "c", 6)]


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(RuntimeError, match="checkpoint"):
        store.shared_dir(Session())
