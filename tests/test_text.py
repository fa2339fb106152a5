"""Tokenizers, normalisation, snippets, scans and scalar functions."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.compat import Compat
from inkwell.functions import scalar as S
from inkwell.functions import text as T
from inkwell.functions.register import register
from inkwell.functions.snippet import Keyword, Snippets, snippet
from inkwell.operators import lexicon
from inkwell.operators.tokenize import Tokenizer
from inkwell.plans.qscan import scan
from inkwell.sources import tsv


def test_ngrams():
    t = Tokenizer("ngram", normalize=True)
    assert t.tokens("AB漢字 c1") == [("ab", 0), ("漢字", 2), ("字", 3), ("c", 4), ("1", 5)]
    assert t.query_tokens("AB漢字 c1")[0] == [("ab", 0), ("漢字", 2), ("c", 4), ("1", 5)]
    assert t.tokens("foo\nbar") == [("foo", 0), ("bar", 3)]
    split = Tokenizer("ngram", normalize=True, split_alpha=True)
    assert split.tokens("abc") == [("ab", 0), ("bc", 1), ("c", 2)]
    assert split.query_tokens("abc")[0] == [("ab", 0), ("bc", 1)]


def test_delimited_controls():
    assert Tokenizer().tokens("foo\nbar") == [("foo", 0), ("bar", 1)]
    assert Tokenizer(normalize=True, compat=Compat(glue_controls=True)).tokens("foo\nbar") == [("foobar", 0)]
    assert Tokenizer(normalize=True).tokens("foo\nBAR") == [("foo", 0), ("bar", 1)]


def test_normalize():
    assert T.normalize("ＡＢＣ ｶﾞ") == "abc ガ"
    assert T.normalize("a\tb\n", remove_blank=True) == "ab"
    assert T.normalize(None) is None
    assert [T.char_type(c) for c in "a1!あア漢"] == [T.ALPHA, T.DIGIT, T.SYMBOL, T.HIRAGANA, T.KATAKANA, T.KANJI]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=30))
def test_offsets_cover_the_text(s):
    chars, starts, ends, blank = T.normalize_with_offsets(s, True)
    assert len(chars) == len(starts) == len(ends) == len(blank)
    assert all(a < b for a, b in zip(starts, ends)) or not chars
    assert ends == sorted(ends)
    assert T.normalize(s.lower(), True) is not None


def test_snippets():
    cut = Snippets([Keyword("贈呈", "(", ")")], 100, 3)
    assert cut("ﾓﾘﾀﾎﾟ ﾎﾟｲﾝﾄ 贈呈") == ["ﾓﾘﾀﾎﾟ ﾎﾟｲﾝﾄ( 贈呈)"]
    cut = Snippets([Keyword("夢", "(", ")")], 300, 1)
    assert cut("あ" + "　" * 5 + "夢いっぱい。") == ["あ(" + "　" * 5 + "夢)いっぱい。"]
    assert Snippets([Keyword("x", "[", "]")], 10, 1, escape=True)("a<x&b") == ["a&lt;[x]&amp;b"]
    got = Snippets([Keyword("b", "[", "]")], 5, 2)("aaaa b aaaaaaaaaaaaa b aaaa")
    assert len(got) == 2
    assert all("b]" in x for x in got)
    with pytest.raises(ValueError):
        Snippets([Keyword("toolong", "", "")], 3, 1)
    assert cut(None) == []


def test_snippet_column_and_sql(spark):
    df = spark.createDataFrame([("one two three",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(snippet(F.col("t"), [("two", "<", ">")], 50, 1, whole_if_none=True)).collect()]
    assert got == [["one< two> three"], None, []]
    register(spark)
    df.createOrReplaceTempView("texts")
    assert spark.sql("SELECT snippet(t, 'two', 50, 1, '<', '>') AS s FROM texts WHERE t <> ''").first().s == ["one< two> three"]
    assert spark.sql("SELECT normalize_text('ＡＢ') AS s").first().s == "ab"
    assert [x.term for x in spark.sql("SELECT tokenize('a b', 'delimited') AS s").first().s] == ["a", "b"]


def test_scan(spark):
    df = spark.createDataFrame([(1, "aaa b", "b"), (2, "b", None), (3, "a a", "c")], "id int, s string, u string")
    run = lambda q: {r.id: (r.f, r.s_) for r in df.select("id", *[c.alias(n) for c, n in zip(scan(q, [F.col("s"), F.col("u")]), ("f", "s_"))]).collect()}
    assert run("aa") == {1: (True, 10), 2: (False, 0), 3: (True, 5)}  # overlaps count, blanks don't part
    assert run("*D+ a b") == {1: (True, 25), 2: (False, 5), 3: (False, 10)}
    assert run("a -b")[1] == (False, 15)


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    s = F.lit("abcdef")
    assert val(S.substrb(s, 1, 3)) == "bcd"
    assert val(S.substrb(s, 0, -1)) == "abcdef"
    assert val(S.substrb(s, -2, -1)) == "f"
    assert val(S.quotient(F.lit(7), F.lit(2))) == 3
    assert val(S.divide(F.lit(2**62 + 1), F.lit(3))) == (2**62 + 1) // 3
    assert val(S.divide(F.lit(-7), F.lit(2))) == -3
    assert math.isinf(val(S.quotient(F.lit(7), F.lit(0))))
    assert val(S.remainder(F.lit(-7), F.lit(2))) == -1
    assert val(S.concat("a", 1)) == "a1"
    assert val(S.repeat(F.lit("ab"), 3)) == "ababab"
    assert val(S.to_number(F.lit("3.5"))) == 3.5
    assert val(S.to_number(F.lit("abc"))) == 0
    assert val(S.is_positive(F.lit(1.5))) is True
    assert val(S.timestr(S.to_time(F.lit("2020/01/02 03:04:05.5")))) == "2020-01-02 03:04:05.500000"
    assert val(S.cdr(F.array(F.lit(1), F.lit(2)))) == [2]
    assert val(S.negate(F.lit(None).cast("boolean"))) is True
    assert val(S.json_read(F.lit('{"a": [1, 2]}'), "a array<int>")).a == [1, 2]


def test_lexicon(spark, tmp_path):
    t = lexicon.create(spark.createDataFrame([("ab",), ("abc",), ("b",), ("ab",), (None,)], "key string"))
    assert [(r.id, r.key) for r in lexicon.scan(t).collect()] == [(1, "ab"), (2, "abc"), (3, "b")]
    t2 = lexicon.get_or_create(t, spark.createDataFrame([("b",), ("z",)], "key string"))
    assert [(r.id, r.key) for r in lexicon.scan(t2).collect()] == [(1, "ab"), (2, "abc"), (3, "b"), (4, "z")]
    assert lexicon.common_prefix_search(t, "abcd").first().key == "abc"
    assert lexicon.common_prefix_search(t, "zz").count() == 0
    got = lexicon.common_prefix_join(spark.createDataFrame([("abx",), ("q",), ("",)], "w string"), "w", t)
    assert {r.w: r.found for r in got.collect()} == {"abx": "ab", "q": None, "": None}
    assert lexicon.at(lexicon.set_pocket(t, "ab", 0x2AAA), "ab").first().pocket == 0x2AAA
    assert lexicon.at(lexicon.add_pocket(t, "ab", -5), "ab").first().pocket == 0
    with pytest.raises(ValueError):
        lexicon.set_pocket(t, "ab", 0x4000)
    assert lexicon.size(lexicon.delete(t, ["ab"])) == 2
    texts = spark.createDataFrame([(1, "xabcab"), (2, None), (3, "é abc")], "id int, t string")
    hits = [(r.id, r.key, r.offset, r.length) for r in lexicon.dictionary_scan(texts, F.col("t"), t).select("id", "key", "offset", "length").collect()]
    assert sorted(hits) == [(1, "ab", 4, 2), (1, "abc", 1, 3), (3, "abc", 3, 3)]
    joined = [(r.id, r.key, r.offset, r.length) for r in lexicon._scan_by_join(texts, F.col("t"), t, "key").select("id", "key", "offset", "length").collect()]
    assert sorted(joined) == sorted(hits)


@pytest.mark.parametrize("normalized", [True, False])
def test_large_dictionary_gives_the_same_hits(spark, monkeypatch, normalized):
    keys = spark.createDataFrame([("ABC",), ("abc",), ("é",), ("fi",), ("ガ",), ("tion of",), ("b c",), ("𝒳y",), ("",), (None,)], "key string")
    rows = ["ＡＢＣ abc ABC", "e\u0301 é", "oﬁ fi", "ｶﾞ ガ カ\u3099", "tion\n of ti\non of", "ab ccc", "𝒳y 𝒳Y", "", None, "abc", "ßabc\u200bABC"]
    texts = spark.createDataFrame(list(enumerate(rows)), "id int, t string")

    def hits():
        return sorted(tuple(r) for r in lexicon.dictionary_scan(texts, F.col("t"), keys, normalized=normalized).select("id", "key", "offset", "length").collect())

    sent = hits()
    monkeypatch.setattr(lexicon, "DICTIONARY_KEYS", 3)
    assert hits() == sent
    if normalized:
        assert {(0, "ABC", 0, 9), (1, "é", 0, 3), (3, "ガ", 0, 6)} <= set(sent)


def test_tsv(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k1\tx\t1\nbad\nk2\ty\t2\nk1\tz\t3\n\nk3\tw\t4\n")
    got = tsv.load_tsv(spark, str(tmp_path / "a.tsv"), ["s", "n"], types={"n": "int"})
    assert sorted(map(tuple, got.collect())) == [("k1", "z", 3), ("k2", "y", 2)]
    assert [r.value for r in tsv.tsv_lines(got.orderBy("_key"), header=True).collect()][0] == "_key\ts\tn"
    assert tsv.json_lines(got.where("_key = 'k2'")).first().value == '{"_key":"k2","s":"y","n":2}'
