from __future__ import annotations

import time
from dataclasses import replace

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import html_extract as H

PAGE = (
    "<html><head><title>T</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav>"
    "<div class='ad'>Buy now</div><article><h1>A title</h1><p>This is the first long paragraph of the page, with a full sentence. And one more.<p>Second &amp; last one, "
    "which has enough words to be text.</article><footer>Copyright 2020</footer><script>var x = '</p>';</script>"
)


def cost(odds, joined, labels):
    unary = sum(z if z > 0 and not x else -z if z < 0 and x else 0 for z, x in zip(odds, labels))
    return unary + sum(c for i, j, c in joined if labels[i] != labels[j])


@pytest.mark.parametrize("seed", range(40))
def test_cut_is_minimal(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 9))
    odds = rng.normal(size=n) * 2
    joined = [(i, j, float(rng.random() * 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
    best = min(cost(odds, joined, x) for x in itertools.product((False, True), repeat=n))
    assert abs(cost(odds, joined, H.minimum_cut(odds, joined)) - best) < 1e-9


def test_blocks():
    got = H.blocks(PAGE)
    assert [b.text for b in got] == ["Home", "About us", "Buy now", "A title", "This is the first long paragraph of the page, with a full sentence. And one more.", "Second & last one, which has enough words to be text.", "Copyright 2020"]
    assert [b.mark for b in got] == [-1, -1, -1, 1, 1, 1, -1]
    assert [b.linked for b in got] == [1, 2, 0, 0, 0, 0, 0]
    for broken in ("", "<", "<p", "</p></div>", "<!-- x", "a < b > c", "<script>", "<p><b>x", "&#xZZ;"):
        H.blocks(broken)


def test_extracts_marked_and_unmarked(spark):
    model = H.fit([PAGE] * 10)
    text, kept, n = H.extract(PAGE, model)
    assert text.splitlines() == [b.text for b in H.blocks(PAGE)][3:6]
    assert (kept, n) == (3, 7)


def test_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    train = pages.where("page_id % 2 = 0")
    model = H.train(train)
    right = total = 0
    for r in pages.where("page_id % 2 = 1").collect():
        found = H.blocks(r.html)
        plain = [replace(b, mark=0) for b in found]  # without the marks
        keep = H.minimum_cut(model.log_odds(plain), H.edges(plain))
        right += sum(bool(k) == (b.mark > 0) for k, b in zip(keep, found))
        total += len(found)
    assert right / total > 0.97


def test_awkward_rows(spark):
    d = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p>" + "word " * 50_000), (5, "u", "no tags at all")], "page_id long, url string, html string")
    d = d.withColumn("text", F.lit("clash")).withColumn("n_blocks", F.lit("clash"))
    rows = H.extracted(d, H.train(d)).collect()
    assert len(rows) == 7
    assert sum(r.page_id is None for r in rows) == 1
    assert {r.page_id: r.text for r in rows if r.page_id in (2, 3)} == {2: "", 3: ""}
    assert H.extracted(d.limit(0), H.train(d.limit(0))).count() == 0


@pytest.mark.parametrize("source", ["<div>x" * 40_000, "<p>some words that go on. " * 20_000, "<div>x</span></b></p>" * 20_000, '<a href="x' * 5000, "<ul>" + "<li>x y z" * 20_000])
def test_unclosed_tags_take_linear_time(source):
    began = time.process_time()
    H.extract(source, H.DEFAULT)
    assert time.process_time() - began < 10


def test_edges_follow_the_tree():
    found = H.blocks("<div><p>a</p><p>b</p><aside><div>ad</div></aside><p>c</p></div><footer>f</footer>")
    assert [b.text for b in found] == ["a", "b", "ad", "c", "f"]
    assert [(b.depth, b.shared) for b in found] == [(2, 0), (2, 1), (3, 1), (2, 1), (1, 0)]
    cost = {(i, j): c for i, j, c in H.edges(found)}
    assert cost[1, 3] == H.NEAR * 0.5  # past the aside
    assert cost[0, 1] > cost[1, 2] > H.ADJACENT
    assert set(cost) == {(0, 1), (1, 2), (2, 3), (3, 4), (1, 3)}
