"""Scores of queries over toy corpora, derived by hand."""

from __future__ import annotations

from dataclasses import replace

import pytest

from inkwell.compat import Compat
from inkwell.operators.index import TextIndex
from inkwell.operators.records import merge
from inkwell.operators.select import sel, select, similar, term_extract, windows
from inkwell.plans import qparse as Q
from inkwell.plans.qcompile import search

C1 = [("d1", "a b a c"), ("d2", "b c"), ("d3", "a"), ("d4", "c b a b"), ("d5", "x y"), ("d6", "a b c a b")]


def scores(r):
    return {tuple(x[c] for c in r.unit) if len(r.unit) > 1 else x[r.unit[0]]: x.score for x in r.df.collect()}


@pytest.fixture(scope="module")
def c1(spark):
    return TextIndex.of_columns(spark.createDataFrame(C1, "k string, t string"), "k", ["t"]).cache()


@pytest.fixture(scope="module")
def c3(spark):
    return TextIndex.of_columns(spark.createDataFrame([("f1", "test", "test test")], "k string, s1 string, s2 string"), "k", ["s1", "s2"]).cache()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a", {"d1": 10, "d3": 5, "d4": 5, "d6": 10}),
        ("a b", {"d1": 15, "d2": 5, "d3": 5, "d4": 15, "d6": 20}),
        ("*D+ a b", {"d1": 15, "d4": 15, "d6": 20}),
        ("+a +c", {"d1": 15, "d4": 10, "d6": 15}),
        ("a -b", {"d3": 5}),
        ("-b a", {"d1": 10, "d3": 5, "d4": 5, "d6": 10}),
        ("a >b", {"d1": 16, "d3": 5, "d4": 17, "d6": 22}),
        ("a <b", {"d1": 14, "d3": 5, "d4": 13, "d6": 18}),
        ("a ~b", {"d1": 9, "d3": 5, "d4": 3, "d6": 8}),
        ('"a b"', {"d1": 5, "d4": 5, "d6": 10}),
        ("*D+ a (b c)", {"d1": 10, "d4": 5, "d6": 10}),
        ('*D+ a ("a b")', {"d1": 5, "d4": 5, "d6": 10}),
        ('*N1"a c"', {"d1": 5, "d6": 5}),
        ('*n1"a c"', {"d1": 5, "d6": 5}),
        ("*E-1 zz", {}),
        ("", {}),
    ],
)
def test_queries(c1, text, want):
    assert scores(search(c1, text)) == want


def test_phrase_and_empty_text(c1):
    assert scores(select(c1, "a b")) == {"d1": 1, "d4": 1, "d6": 2}
    assert scores(select(c1, "")) == {}
    assert scores(select(c1, "a zz")) == {}


def test_escalation_and_star(spark):
    ix = TextIndex.of_columns(spark.createDataFrame([("e1", "ab aa aa")], "k string, t string"), "k", ["t"])
    assert scores(select(ix, "a", "prefix")) == {"e1": 1}
    sane = replace(ix, compat=Compat(first_posting_only=False))
    assert scores(select(sane, "a", "prefix")) == {"e1": 3}
    assert scores(search(ix, "a")) == {"e1": 3}
    assert scores(search(ix, "a*")) == {"e1": 3}
    star = replace(ix, compat=Compat(prefix_star=True))
    assert scores(search(star, "a*")) == {"e1": 5}
    assert scores(sel(ix, "a")) == {"e1": 1}


def test_units_and_sections(c3):
    assert [tuple(x) for x in select(c3, "test").df.collect()] == [("f1", 3, 2)]
    assert scores(select(c3, "test", unit="section")) == {("f1", 1): 1, ("f1", 2): 2}
    assert scores(select(c3, "test", unit="position")) == {("f1", 1, 0): 1, ("f1", 2, 0): 1, ("f1", 2, 1): 1}
    r = search(c3, "*W2:3 test")
    assert [tuple(x) for x in r.df.collect()] == [("f1", 6, 1)]
    g = select(c3, "test", unit="section").group("document", limit=1)
    row = g.df.first()
    assert (row.rid, row.score, row.n_subrecs) == ("f1", 3, 2)
    assert [(s.score, s.sid) for s in row.subrecs] == [(2, 2)]
    assert scores(select(c3, "test", weight=lambda rid, sid: sid * 10)) == {"f1": 50}


def test_set_algebra(spark, c1):
    from inkwell.operators.records import Records

    make = lambda rows: Records(spark.createDataFrame(rows, "rid string, score long, n_subrecs long"))
    a, b = make([("d1", 10, 1), ("d2", 5, 1)]), make([("d2", 7, 1), ("d3", 1, 1), ("d4", 1, 1)])
    assert scores(a.union(b)) == {"d1": 10, "d2": 5, "d3": 1, "d4": 1}
    assert scores(a.subtract(b)) == {"d1": 10}
    assert scores(a.intersect(b)) == {"d2": 5}
    assert scores(b.intersect(a)) == {"d2": 5}
    x, y, n = a.difference(b)
    assert (scores(x), scores(y), n) == ({"d1": 10}, {"d3": 1, "d4": 1}, 1)
    assert a.find("d1") == 10
    assert a.find("zz") == 0
    assert [r.rid for r in a.sort(limit=1).collect()] == ["d1"]
    assert [r.score for r in merge([a, b]).collect()] == [10, 7, 5, 1, 1]
    with pytest.raises(ValueError):
        a.union(select(c1, "a", unit="section"))


def test_similar_and_extract(c1):
    # of 6 documents a is in 4, b in 4, c in 4: every weight is 1 + 24 div 4
    assert scores(similar(c1, "a", 5)) == {"d1": 14, "d3": 7, "d4": 7, "d6": 14}
    assert scores(term_extract(c1, "xa", policy=1)) == {"d1": 1, "d3": 1, "d4": 1, "d5": 1, "d6": 1}
    assert scores(term_extract(c1, "xa")) == {("d5", 0): 1, ("d1", 1): 2, ("d3", 1): 2, ("d4", 1): 2, ("d6", 1): 2}


def test_windows():
    assert windows([[0, 10], [1, 30]], 3) == 1
    assert windows([[0, 5], [2, 6]], 2) == 2
    assert windows([[0], []], 5) == 0


def test_parser():
    q = Q.parse('*E2,1*D+*W1:4,3 a "b \\" c" (d OR e) -f g*')
    assert (q.threshold, q.decay, q.default_op, q.weights) == (2, 1, "and", {1: 4, 3: 1})
    assert list(q.terms()) == ["a", 'b " c', "d", "e", "f", "g"]
    assert list(q.keywords()) == ["a", 'b " c', "d", "e", "g"]
    assert Q.parse("a b c", max_operands=2).rest.strip() == "c"
    assert list(Q.parse("-a b").keywords()) == ["a", "b"]


def test_differential(spark, c1):
    """Random queries of words and operators against a fold over dictionaries."""
    import random

    rng = random.Random(5)
    tf = {d: {w: t.split().count(w) for w in "abcxy"} for d, t in C1}
    for _ in range(12):
        n = rng.randint(1, 4)
        ops = [rng.choice(["", "+", "-", ">", "<", "~", "OR "]) for _ in range(n)]
        words = [rng.choice("abcxy") for _ in range(n)]
        out: dict[str, int] = {}
        first = True
        for o, w in zip(ops, words):
            hit = {d: c[w] for d, c in tf.items() if c[w]}
            if first:
                if o == "-":
                    continue
                weight = {"~": -1, ">": 6, "<": 4}.get(o, 5)
                out = {d: n * weight for d, n in hit.items()}
                first = False
            elif o in ("", "OR "):
                out = {d: out.get(d, 0) + 5 * hit.get(d, 0) for d in {*out, *hit}}
            elif o == "+":
                out = {d: s + 5 * hit[d] for d, s in out.items() if d in hit}
            elif o == "-":
                out = {d: s for d, s in out.items() if d not in hit}
            else:
                out = {d: s + {">": 6, "<": 4, "~": -1}[o] * hit.get(d, 0) for d, s in out.items()}
        text = "*E-1 " + " ".join(o + w for o, w in zip(ops, words))
        assert scores(search(c1, text)) == out, text


def test_query_snippets(spark):
    from pyspark.sql import functions as F

    from inkwell.plans.qsnippet import query_snippet

    df = spark.createDataFrame([("one two three four",)], "t string")
    got = df.select(query_snippet(F.col("t"), "one -two three", [("<", ">"), ("[", "]")], 50, 1).alias("s")).first().s
    assert got == ["<one> two[ three] four"]


def test_info():
    import inkwell

    assert inkwell.info()["version"] == inkwell.__version__
