"""Index updates, tables and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.operators.index import TextIndex, fresh_path, sections
from inkwell.operators.select import select
from inkwell.operators.table import Catalog, Slot
from inkwell.operators.tokenize import Tokenizer
from inkwell.plans.qcompile import search
from inkwell.streaming.ingest import follow


def docs(spark, rows):
    return spark.createDataFrame(rows, "k string, t string")


def hits(ix, text):
    return {r.rid: r.score for r in select(ix, text).df.collect()}


def everything(ix):
    return sorted((r.term, r.rid, r.sid, r.tf, r.wsum, tuple(r.positions)) for r in ix.postings.collect())


def test_updates_equal_a_rebuild(spark):
    ix = TextIndex.of_columns(docs(spark, [("1", "a b"), ("2", "b c"), ("3", "c")]), "k", ["t"]).save(fresh_path(spark))
    ix = ix.upsert(sections(docs(spark, [("2", "x"), ("4", "a a")]), "k", ["t"]))
    ix = ix.delete(spark.createDataFrame([("3",)], "rid string"))
    want = TextIndex.of_columns(docs(spark, [("1", "a b"), ("2", "x"), ("4", "a a")]), "k", ["t"])
    assert everything(ix) == everything(want)
    small = ix.compact()
    assert everything(small) == everything(want)
    assert small.info()["documents"] == 3
    moved = small.rename(fresh_path(spark))
    assert hits(moved, "a") == {"1": 1, "4": 2}
    moved.remove()


def test_deleting_sections(spark):
    rows = spark.createDataFrame([("1", "test", "word")], "k string, a string, b string")
    ix = TextIndex.of_columns(rows, "k", ["a", "b"])
    assert hits(ix.delete(spark.createDataFrame([("1",)], "rid string")), "word") == {}
    marked = ix.mark_deleted(spark.createDataFrame([("1",)], "rid string"))
    assert hits(marked, "word") == {"1": 1}
    assert hits(marked.live(), "word") == {}


def test_many_documents(spark):
    ix = TextIndex.of_columns(spark.range(32788).select(F.col("id").alias("k"), F.lit("test").alias("t")), "k", ["t"])
    assert search(ix, "*D+ test hoge").count() == 0
    assert select(ix, "test").count() == 32788
    assert search(ix.delete(spark.range(32788).select(F.col("id").alias("rid"))), "test").count() == 0


def test_boolean_over_sentences(spark):
    texts = ["a guide to support and lists", "collections of notes", "support groups", "no match", "foo bar support"]
    ix = TextIndex.of_columns(docs(spark, [(str(i), t) for i, t in enumerate(texts)]), "k", ["t"])
    assert search(ix, "+(support collections) +foobar*").count() == 0
    assert search(ix, "+(+(support collections)) +foobar*").count() == 0


def test_huge_document(spark):
    big = "aaaaiiiiuuuueeee" * 2**12
    ix = TextIndex.of_columns(docs(spark, [("1", big)]), "k", ["t"], Tokenizer("ngram", normalize=True, split_alpha=True))
    assert select(ix, "uuuu").count() == 1


def test_weights_and_values(spark):
    rows = spark.createDataFrame([("1", 1, [("test", 0)]), ("2", 1, [("test", 1000)]), ("3", 1, [("x y", 0), ("z", 0)])], "rid string, sid int, values array<struct<str:string,weight:int>>")
    ix = TextIndex.build(rows)
    r = select(ix, "test")
    assert [x.rid for x in r.sort().collect()] == ["2", "1"]
    assert [x.rid for x in r.sort(ascending=True).collect()] == ["1", "2"]
    assert hits(ix, "y z") == {}  # values are apart


@pytest.fixture
def shop(spark):
    c = Catalog(spark)
    c.create_table("city", spark.createDataFrame([("r", "Rome"), ("o", "Oslo")], "_key string, name string"), slots={"name": Slot("text")})
    c.create_table("shop", spark.createDataFrame([("s1", "r", 5, "old books"), ("s2", "o", None, "new books"), ("s3", None, 2, "")], "_key string, city string, n int, about string"), slots={"city": Slot("reference", "city"), "n": Slot("int"), "about": Slot("text")})
    c.create_table("terms")
    c.build_index("terms", "about", "shop", "about")
    return c


def keys(df, c="rid"):
    return sorted(r[c] for r in df.collect())


def test_tables(shop, spark):
    t = shop.tables["shop"]
    assert keys(t.scan_select(F.col("n") > 3).df) == ["s1"]
    assert keys(t.scan_select(F.col("city_name") == "Oslo", paths=("city.name",)).df) == ["s2"]
    every = t.as_records()
    assert [r._key for r in t.sort(every, "n", ascending=True).collect()] == ["s2", "s3", "s1"]
    assert [r._key for r in t.sort(every, "city.name").collect()] == ["s1", "s2", "s3"]
    assert {r.rid: r.n_subrecs for r in t.group(every, "city").df.collect()} == {"r": 1, "o": 1, None: 1}
    assert keys(shop.search("terms", "about", "books").df) == ["s1", "s2"]
    assert keys(shop.postings_of("terms", "about", "old")) == ["s1"]
    assert shop.names("s") == ["shop"]
    assert "define shop.city reference city" in t.schema()
    with pytest.raises(ValueError):
        shop.create_table("a.b")


def test_updates_reach_the_index(shop, spark):
    t = shop.tables["shop"].upsert(spark.createDataFrame([("s1", "maps"), ("s4", "books")], "_key string, about string"))
    assert keys(shop.search("terms", "about", "books").df) == ["s2", "s4"]
    assert t.get("s1").city == "r"
    t = t.delete(["s2"])
    assert keys(shop.search("terms", "about", "books").df) == ["s4"]
    t = t.update("about", F.lit("books"), F.col("_key") == "s1")
    assert keys(shop.search("terms", "about", "books").df) == ["s1", "s4"]
    t = t.define("size", "uint")
    assert t.undefine("size").slot_names() == ["shop.city", "shop.n", "shop.about"]
    shop.drop("shop")
    assert not shop.indexes


def test_text_too_long(shop, spark):
    with pytest.raises(Exception, match="longer"):
        shop.tables["city"].upsert(spark.createDataFrame([("x", "y" * 70000)], "_key string, name string")).df.collect()


def test_stream(spark, tmp_path):
    for i, rows in enumerate([[("1", "a b"), ("2", "b")], [("2", "c"), ("3", "a")]]):
        docs(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    at = fresh_path(spark)
    TextIndex.of_columns(docs(spark, []), "k", ["t"]).save(at)
    stream = spark.readStream.schema("k string, t string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    follow(stream, at, "k", ["t"], str(tmp_path / "progress")).awaitTermination()
    ix = TextIndex.open(spark, at)
    assert hits(ix, "a") == {"1": 1, "3": 1}
    assert hits(ix, "b") == {"1": 1}
    assert hits(ix, "c") == {"2": 1}
