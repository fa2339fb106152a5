"""Benchmark decontamination: BM25 over the test items, block-max WAND, overlap check.

The index holds the test items. Each training document is cut into passages of
two strides of words, one starting every stride, and every passage is a query.
An item's stride is ``STRIDE`` or the next doubling of it that is as long as the
item, so an item that a document contains lies whole in some passage, and long
items don't widen the passages of short ones. An item's BM25 score is divided by
its score against itself; passages retrieve all items with ``RETRIEVE`` or more.
Document frequencies and the mean length are those of all items, so it makes no
difference into how many indexes (one or more a stride) they are cut.

Retrieval is block-max WAND with blocks of neighbouring item numbers. The most
common terms are set aside as long as together they can't bring any item to the
threshold (WAND's lists before the pivot); the others add up their block
maxima, and only blocks that can still reach the threshold are scored in full.
A batch of passages goes through each step at once. No hit is lost.

A hit counts if both the question's and the answer's word trigrams occur in
the passage to the extent of ``OVERLAP``. The answer is an item's last sentence,
or its last quarter where it is one sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import textvec as tv
from inkwell.llm.common import ints, lower_text
from inkwell.llm.storage import prepare

RETRIEVE = 0.5
OVERLAP = 0.5
STRIDE = 64
BLOCK = 8
K1, B = 1.2, 0.75
INDEX_BYTES = 32_000_000  # item text of the indexes of one pass over the documents; more items make several passes
CELLS = 1 << 22  # scores and bounds that are held at once
SCHEMA = "doc_id long, item_id long, passage int, score double, question_overlap double, answer_overlap double"


def grams(terms: np.ndarray) -> np.ndarray:
    """Hashes of word trigrams; of the words where there are fewer than three."""
    h = terms.astype(np.uint64)
    if len(h) < 3:
        return tv.mix(h)
    return tv.mix(tv.mix(tv.mix(h[:-2]) + h[1:-1]) * np.uint64(3) + h[2:])


def split_item(text: str) -> tuple[str, str]:
    """(question, answer)."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if len(_words(p))]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    k = len(w) - max(1, len(w) // 4)
    return " ".join(w[:k]), " ".join(w[k:])


def _words(text: str) -> np.ndarray:
    low = lower_text(pa.array([text], pa.string()))
    return next(tv.words(buf, off)[0] for _, _, buf, off in tv.slices(low))


@dataclass
class Statistics:
    """Document frequencies, number and mean length of all items that have a word."""

    n: int
    mean: float
    vocab: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, texts: Iterable[str | None]) -> Statistics:
        n, words, parts, vocab, df = 0, 0, [], np.empty(0, np.int64), np.empty(0, np.int64)

        def merge() -> tuple[np.ndarray, np.ndarray]:
            flat, inv = np.unique(np.concatenate([vocab, *parts]), return_inverse=True)
            return flat, np.bincount(inv, np.concatenate([df, np.ones(len(inv) - len(df))]), len(flat)).astype(np.int64)

        for t in texts:
            w = _words(t) if t else ()
            if len(w):
                n, words = n + 1, words + len(w)
                parts.append(np.unique(w))
                if len(parts) == 10_000:
                    vocab, df = merge()
                    parts = []
        vocab, df = merge()
        return cls(n, words / max(n, 1), vocab, df)


def stride_of(n_words: int) -> int:
    out = STRIDE
    while out < n_words:
        out *= 2
    return out


class Index:
    """Impacts of the terms of some items, normalised to 1 for an item against itself."""

    def __init__(self, items: list[tuple[int | None, str]], retrieve: float = RETRIEVE, block: int = BLOCK, stats: Statistics | None = None):
        kept = [(i, w, t) for i, t in items if t and len(w := _words(t))]
        kept.sort(key=lambda x: (x[1].min(), x[0] is None, x[0] or 0))
        stats = stats or Statistics.of(t for _, t in items)
        self.ids = [i for i, _, _ in kept]
        self.n, self.block, self.retrieve = len(kept), block, retrieve
        self.stride = max([STRIDE, *(stride_of(len(w)) for _, w, _ in kept)])
        self.parts = []
        for _, _, t in kept:
            q, a = split_item(t)
            qw, aw = (_words(x) if x else np.empty(0, np.int64) for x in (q, a))
            self.parts.append([(len(w) < 3, np.unique(grams(w))) for w in (qw, aw)])
        if not self.n:
            return
        item = np.repeat(np.arange(self.n), [len(w) for _, w, _ in kept])
        vocab, t = np.unique(np.concatenate([w for _, w, _ in kept]), return_inverse=True)
        key, tf = np.unique(t.astype(np.int64) * self.n + item, return_counts=True)
        t, item = key // self.n, key % self.n
        length = np.array([len(w) for _, w, _ in kept], float)
        df = stats.df[np.searchsorted(stats.vocab, vocab)]
        idf = np.log1p((stats.n - df + 0.5) / (df + 0.5))
        w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / stats.mean))
        w = w / np.bincount(item, w, self.n)[item]
        self.table = tv.TermTable(vocab)
        self.at, self.item, self.w = np.searchsorted(t, np.arange(len(vocab) + 1)), item, w
        # the most common terms, while no item can get half the threshold from them
        self.spare, rest = np.zeros(self.n), np.zeros(len(vocab), bool)
        for k in np.argsort(-df, kind="stable").tolist():
            lo, hi = self.at[k], self.at[k + 1]
            new = self.spare.copy()
            new[item[lo:hi]] += w[lo:hi]
            if new.max() >= retrieve / 2:
                break
            self.spare, rest[k] = new, True
        self.common = rest
        self.n_blocks = -(-self.n // block)
        self.spare_block = np.array([self.spare[k * block : (k + 1) * block].max() for k in range(self.n_blocks)])
        bkey = t * self.n_blocks + item // block
        u, first = np.unique(bkey, return_index=True)
        self.bmax = np.maximum.reduceat(w, first)
        self.bblock, bt = u % self.n_blocks, u // self.n_blocks
        self.bat = np.searchsorted(bt, np.arange(len(vocab) + 1))

    def search(self, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, passage, item, score) of all passages and items with the threshold's score."""
        e = np.empty(0, np.int64)
        none = e, e, e, np.empty(0)
        if not self.n or not len(terms):
            return none
        units = -(-np.diff(first) // self.stride)  # a passage is a unit and the next one
        base = np.concatenate(([0], np.cumsum(units)))
        got = self.table.find(terms)
        at = np.flatnonzero(got >= 0)
        got = got[at].astype(np.int64)
        row = np.searchsorted(first, at, side="right") - 1
        unit = base[row] + (at - first[row]) // self.stride
        later = unit > base[row]
        v = len(self.at) - 1
        main = ~self.common[got]
        key = np.concatenate((unit[main] * v + got[main], (unit[main & later] - 1) * v + got[main & later]))
        key.sort()
        if not len(key):
            return none
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        p, t = key // v, key % v
        n_units = int(base[-1])
        alive = self._live(p, t)
        if not len(alive):
            return none
        want = np.zeros(n_units, bool)
        want[alive // self.n_blocks] = True
        a, b = want[unit], later & want[np.maximum(unit - 1, 0)]
        key = np.unique(np.concatenate((unit[a] * v + got[a], (unit[b] - 1) * v + got[b])))
        p, hit, score = self._scored(key // v, key % v, alive)
        row = np.searchsorted(base, p, side="right") - 1
        return row, p - base[row], hit, score

    def _chunks(self, p: np.ndarray, wide: int) -> Iterator[tuple[slice, int, int]]:
        """Runs of the sorted passages p, so that ``wide`` cells for each stay within CELLS: (positions, first passage, passages)."""
        many = max(1, CELLS // wide)
        lo = 0
        while lo < len(p):
            hi = int(np.searchsorted(p, p[lo] + many))
            yield slice(lo, hi), int(p[lo]), int(p[hi - 1] - p[lo]) + 1
            lo = hi

    def _live(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """passage * n_blocks + block where the block maxima of the passage's terms can reach the threshold."""
        out = [np.empty(0, np.int64)]
        for at, first, many in self._chunks(p, self.n_blocks):
            n = self.bat[t[at] + 1] - self.bat[t[at]]
            post = tv.ragged(self.bat[t[at]], n)
            bound = np.bincount(np.repeat(p[at] - first, n) * self.n_blocks + self.bblock[post], self.bmax[post], many * self.n_blocks)
            some = np.flatnonzero(bound)
            out.append(some[bound[some] + self.spare_block[some % self.n_blocks] >= self.retrieve - 1e-9] + first * self.n_blocks)
        return np.concatenate(out)

    def _scored(self, p: np.ndarray, t: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of the items in live blocks that reach the threshold."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at, first, many in self._chunks(p, max(self.n, self.n_blocks)):
            here = alive[np.searchsorted(alive, first * self.n_blocks) : np.searchsorted(alive, (first + many) * self.n_blocks)] - first * self.n_blocks
            open_ = np.zeros(many * self.n_blocks, bool)
            open_[here] = True
            n = self.at[t[at] + 1] - self.at[t[at]]
            post = tv.ragged(self.at[t[at]], n)
            pp, item = np.repeat(p[at] - first, n), self.item[post]
            ok = open_[pp * self.n_blocks + item // self.block]
            score = np.bincount(pp[ok] * self.n + item[ok], self.w[post][ok], many * self.n)
            hit = np.flatnonzero(score >= self.retrieve - 1e-9)
            out.append((hit // self.n + first, hit % self.n, score[hit]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def verified(self, terms: np.ndarray, first: np.ndarray, overlap: float = OVERLAP) -> dict[tuple[int, int], tuple]:
        """{(row, item): (passage, score, question's overlap, answer's)}: of each pair the passage with the most overlap, then the first."""
        best: dict[tuple[int, int], tuple] = {}
        for row, passage, item, score in zip(*(x.tolist() for x in self.search(terms, first))):
            lo = first[row] + passage * self.stride
            seen = terms[lo : min(lo + 2 * self.stride, first[row + 1])]
            three, one = grams(seen), tv.mix(seen.astype(np.uint64))
            share = [np.isin(g, one if short else three).mean() if len(g) else 1.0 for short, g in self.parts[item]]
            if min(share) >= overlap:
                new = (passage, score, *map(float, share))
                old = best.get((row, item))
                if old is None or (-sum(new[2:]), passage) < (-sum(old[2:]), old[0]):
                    best[row, item] = new
        return best


def indexes(items: DataFrame, retrieve: float = RETRIEVE, limit: int | None = None) -> Iterator[list[Index]]:
    """The indexes of each pass: those of all items, one for each stride, of a bounded size together.

    The items are read twice on the driver, one after another; it holds the
    text of one pass and a number for each different word of the items.
    """
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    stats = Statistics.of(r[1] for r in rows.toLocalIterator())
    held, size = {}, 0
    for r in rows.toLocalIterator():
        n = len(_words(r[1])) if r[1] else 0
        if n:
            held.setdefault(stride_of(n), []).append((r[0], r[1]))
            size += len(r[1])
        if size > (INDEX_BYTES if limit is None else limit):
            yield [Index(x, retrieve, stats=stats) for _, x in sorted(held.items())]
            held, size = {}, 0
    if held:
        yield [Index(x, retrieve, stats=stats) for _, x in sorted(held.items())]


def hits(docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """One row for each document and test item found in it; scores are rounded to 6 places.

    Null and empty texts and items match nothing; a null doc_id or item_id is
    reported as null. Rows that repeat an id are looked at each and give equal
    rows. Other columns aren't read. No items or no documents: no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for some in indexes(items, retrieve):
        shared = spark.sparkContext.broadcast(some)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in it:
                ids = b.column(0).to_pylist()
                rows = []
                for lo, _, buf, off in tv.slices(lower_text(b.column(1))):
                    words = tv.words(buf, off)
                    for ix in shared.value:
                        for (row, item), got in sorted(ix.verified(*words, overlap).items()):
                            rows.append((ids[lo + row], ix.ids[item], got[0], round(got[1], 6), *got[2:]))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"), r)) for r in rows],
                    pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passage", pa.int32()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]),
                )

        got = docs.mapInArrow(run, SCHEMA)
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """``docs`` without the rows in which a test item is found; columns unchanged, null texts stay."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index("text")
    for some in indexes(items, retrieve):
        shared = spark.sparkContext.broadcast(some)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in it:
                keep = np.ones(b.num_rows, bool)
                for lo, _, buf, off in tv.slices(lower_text(b.column(at))):
                    words = tv.words(buf, off)
                    for ix in shared.value:
                        for row, _ in ix.verified(*words, overlap):
                            keep[lo + row] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def sql() -> str:
    """DuckDB SQL of ``hits`` over documents and benchmark: every passage is scored against every item."""
    words = lambda x: f"regexp_extract_all(lower({x}), '{tv.WORD_RE}')"
    return f"""
WITH i0 AS (SELECT row_number() OVER () AS iid, item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x, {words("text")} AS w FROM benchmark WHERE text IS NOT NULL),
i1 AS (SELECT *, list_filter(regexp_split_to_array(x, '[.?!]\\s+|\\n+'), lambda p: len({words("p")}) > 0) AS parts, regexp_split_to_array(x, '\\s+') AS sp FROM i0 WHERE len(w) > 0),
i2 AS (SELECT *, CASE WHEN len(parts) > 1 THEN array_to_string(parts[:len(parts) - 1], ' ') ELSE array_to_string(sp[:len(sp) - greatest(1, len(sp) // 4)], ' ') END AS qt,
  CASE WHEN len(parts) > 1 THEN parts[len(parts)] ELSE array_to_string(sp[len(sp) - greatest(1, len(sp) // 4) + 1:], ' ') END AS anst FROM i1),
item AS (SELECT iid, item_id, w, {words("qt")} AS q, {words("anst")} AS a, ({STRIDE} * pow(2, greatest(0, ceil(log2(len(w)::DOUBLE / {STRIDE})))))::BIGINT AS stride FROM i2),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM item),
it AS (SELECT iid, t, count(*)::DOUBLE AS tf FROM (SELECT iid, unnest(w) AS t FROM item) GROUP BY iid, t),
df AS (SELECT t, count(*)::DOUBLE AS df FROM it GROUP BY t),
raw AS (SELECT iid, t, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * len(w) / mean)) AS x FROM it JOIN df USING (t) JOIN item USING (iid), n),
wt AS (SELECT iid, t, x / sum(x) OVER (PARTITION BY iid) AS x FROM raw),
d AS (SELECT row_number() OVER () AS did, doc_id, {words("text")} AS w FROM documents WHERE text IS NOT NULL),
tok AS (SELECT did, stride, unnest(w) AS t, unnest(range(len(w))) // stride AS u FROM d, (SELECT DISTINCT stride FROM item)),
pas AS (SELECT DISTINCT did, stride, u AS p, t FROM tok UNION SELECT DISTINCT did, stride, u - 1, t FROM tok WHERE u > 0),
sc AS (SELECT did, p, iid, sum(x) AS score FROM pas JOIN (SELECT wt.*, stride FROM wt JOIN item USING (iid)) USING (t, stride) GROUP BY did, p, iid HAVING sum(x) >= {RETRIEVE} - 1e-9),
c AS (SELECT sc.*, d.doc_id, d.w[p * stride + 1:(p + 2) * stride] AS seen, item.item_id, item.q, item.a FROM sc JOIN d USING (did) JOIN item USING (iid)),
g AS (SELECT *, list_transform(range(1, len(seen) - 1), lambda k: seen[k] || ' ' || seen[k + 1] || ' ' || seen[k + 2]) AS three,
  list_distinct(CASE WHEN len(q) < 3 THEN q ELSE list_transform(range(1, len(q) - 1), lambda k: q[k] || ' ' || q[k + 1] || ' ' || q[k + 2]) END) AS qg,
  list_distinct(CASE WHEN len(a) < 3 THEN a ELSE list_transform(range(1, len(a) - 1), lambda k: a[k] || ' ' || a[k + 1] || ' ' || a[k + 2]) END) AS ag FROM c),
o AS (SELECT did, iid, doc_id, item_id, p, score,
  CASE WHEN len(qg) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(qg, lambda z: list_contains(CASE WHEN len(q) < 3 THEN seen ELSE three END, z)))::DOUBLE / len(qg) END AS qo,
  CASE WHEN len(ag) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(ag, lambda z: list_contains(CASE WHEN len(a) < 3 THEN seen ELSE three END, z)))::DOUBLE / len(ag) END AS ao FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY did, iid ORDER BY qo + ao DESC, p) AS rn FROM o WHERE least(qo, ao) >= {OVERLAP})
SELECT doc_id, item_id, p::INTEGER AS passage, round(score, 6) AS score, qo AS question_overlap, ao AS answer_overlap FROM r WHERE rn = 1"""
