"""A written inverted index, sharded by documents, and exhaustive scoring over it.

Texts are tokenised once. A shard holds up to ``SHARD_DOCS`` documents of a task,
about ``SHARD_BYTES`` of text, as one row: the documents' ids and lengths, the
sorted terms and their postings (document number, term frequency). No row is
exchanged: a shard is made where its documents are read, so no key, source or
group of copies makes one larger than another. Queries come in blocks of a
bounded size; a block is broadcast and meets every shard.

Impacts are BM25 in whole thousandths, floor(1000 * idf * tf part), so sums are
exact and don't depend on their order. Terms that many of a shard's documents
have are kept as dense rows, and a chunk of queries meets them in one matrix
product; it runs in single precision where no sum can pass 2**24, else in double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import textvec as tv
from inkwell.llm.common import ints, lower_text
from inkwell.llm.storage import Written, prepare

K1, B = 1.2, 0.75
DOC_BITS = 14
SHARD_DOCS = 1 << DOC_BITS  # a document's number and a term share a 64-bit key
SHARD_BYTES = 12_000_000
DENSE = 0.06  # share of a shard's documents from which a term's postings are a dense row
CHUNK = 128  # queries of one matrix product
QUERY_BYTES = 16_000_000  # query text of one block; more queries make several
_TERM_BITS = 48
_TERM = _TERM_BITS // 8  # bytes of a stored term
_ARRAYS = {"ids": np.int64, "sizes": np.int32, "vocab": np.uint8, "counts": np.int32, "who": np.uint16, "tf": np.uint8, "big_at": np.int32, "big_tf": np.int32}
SCHEMA = "shard long, docs int, words long, " + ", ".join(f"{x} binary" for x in _ARRAYS)


def short(terms: np.ndarray) -> np.ndarray:
    """The leading 48 bits of terms: 10**8 distinct words collide about twenty times."""
    return terms >> (tv.TERM_BITS - _TERM_BITS)


def _shard(ids: np.ndarray, terms: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    low = np.uint64(DOC_BITS)
    key = (terms.astype(np.uint64) << low) | np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    tf = np.diff(np.append(new, len(key)))
    key = key[new]
    term = key >> low
    at = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
    vocab = term[at].view(np.uint8).reshape(-1, 8)[:, :_TERM]
    big = np.flatnonzero(tf >= 255)
    return [ids, sizes, vocab, np.diff(np.append(at, len(term))), key & np.uint64(SHARD_DOCS - 1), np.minimum(tf, 255), big, tf[big]]


def build(docs: DataFrame) -> Written:
    """The index of all rows of (doc_id, text) that have an id; null texts are empty documents."""
    prepare(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, terms, sizes, n, size = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal number, n, size
            got = [np.concatenate(x) for x in (ids, terms, sizes)]
            arrays = [x.astype(kind) for x, kind in zip(_shard(*got), _ARRAYS.values())]
            number += 1
            for x in (ids, terms, sizes):
                x.clear()
            n, size = 0, 0
            row = [pa.array([number]), pa.array([len(got[0])], pa.int32()), pa.array([len(got[1])], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)]
            return pa.record_batch(row, ["shard", "docs", "words", *_ARRAYS])

        for b in it:
            name, known = ints(b.column(0))
            if not known.all():
                b, name = b.filter(pa.array(known)), name[known]
            for lo, hi, buf, off in tv.slices(lower_text(b.column(1))):
                if n and (n + hi - lo > SHARD_DOCS or size + len(buf) > SHARD_BYTES):
                    yield flush()
                t, first = tv.words(buf, off)
                ids.append(name[lo:hi])
                terms.append(short(t))
                sizes.append(np.diff(first))
                n, size = n + hi - lo, size + len(buf)
        if n:
            yield flush()

    return Written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA), "postings")


class Block:
    """Queries (id, text) as sparse rows of term counts over the block's own terms."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [r[0] for r in rows]
        terms, lens = [], []
        for lo, hi, buf, off in tv.slices(lower_text(pa.array([t or "" for _, t in rows], pa.large_string()))):
            t, first = tv.words(buf, off)
            terms.append(short(t))
            lens.append(np.diff(first))
        self.lens = np.concatenate(lens) if lens else np.empty(0, np.int64)
        flat = np.concatenate(terms) if terms else np.empty(0, np.int64)
        self.vocab, t = np.unique(flat, return_inverse=True)
        v = max(len(self.vocab), 1)
        key, self.qtf = np.unique(np.repeat(np.arange(len(rows)), self.lens) * v + t, return_counts=True)
        self.term = (key % v).astype(np.int32)
        self.at = np.searchsorted(key // v, np.arange(len(rows) + 1))


def blocks(queries: DataFrame, limit: int | None = None) -> Iterator[Block]:
    """Blocks of (id, text) rows in the order of the table, each of a bounded size; one empty block if there is no row."""
    held, size, some = [], 0, False
    for r in queries.toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "")
        if size > (QUERY_BYTES if limit is None else limit):
            yield Block(held)
            held, size, some = [], 0, True
    if held or not some:
        yield Block(held)


def part(tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    """BM25's part of term frequency and length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


class Statistics:
    """Document frequencies of a block's terms over the whole index, its documents and mean length."""

    def __init__(self, index: DataFrame, block: Block):
        spark = index.sparkSession
        shared = spark.sparkContext.broadcast(block.vocab)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms = shared.value
            df, n_docs, n_words = np.zeros(len(terms), np.int64), 0, 0
            for docs, words, vocab, counts in (r for b in it for r in zip(*(c.to_pylist() for c in b.columns))):
                n_docs, n_words = n_docs + docs, n_words + words
                at, there = _find(_vocab(vocab), terms)
                df[there] += np.frombuffer(counts, np.int32)[at]
            has = np.flatnonzero(df)
            yield pa.record_batch([pa.array(np.concatenate((has, [-1, -2]))), pa.array(np.concatenate((df[has], [n_docs, n_words])))], ["t", "n"])

        got = index.select("docs", "words", "vocab", "counts").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
        total = dict(zip(got["t"].to_pylist(), got["n"].to_pylist()))
        self.docs, words = total.pop(-1, 0), total.pop(-2, 0)
        self.mean = words / self.docs if words else 1.0
        df = np.zeros(len(block.vocab))
        df[np.fromiter(total.keys(), np.int64, len(total))] = np.fromiter(total.values(), np.int64, len(total))
        self.idf = np.log(1 + (self.docs - df + 0.5) / (df + 0.5))
        shared.unpersist()


def _vocab(raw: bytes) -> np.ndarray:
    packed = np.frombuffer(raw, np.uint8).reshape(-1, _TERM)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :_TERM] = packed
    return out.view(np.int64).ravel()


def _find(vocab: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the shard, positions in the block) of the terms that both have; both are sorted."""
    if not len(vocab):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(vocab, terms), len(vocab) - 1)
    there = np.flatnonzero(vocab[at] == terms)
    return at[there], there


class Shard:
    """A shard's postings of a block's terms, weighted."""

    def __init__(self, row: tuple, block: Block, idf: np.ndarray, mean: float):
        ids, sizes, vocab, counts, who, tf, big_at, big_tf = (np.frombuffer(x, kind) for x, kind in zip(row, _ARRAYS.values()))
        self.ids, self.sizes = ids, sizes
        at, there = _find(_vocab(vocab), block.vocab)
        start, n = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[at], counts[at].astype(np.int64)
        post = tv.ragged(start, n)
        begin = np.zeros(len(block.vocab) + 1, np.int64)
        begin[there + 1] = n
        self.begin = np.cumsum(begin)
        f = tf.astype(np.int64)
        f[big_at] = big_tf
        f, d = f[post].astype(float), who[post]
        impact = np.floor(1000 * (np.repeat(idf[there], n) * part(f, sizes[d], mean)))
        self.packed = (impact.astype(np.uint32) << np.uint32(DOC_BITS)) | d
        often = np.flatnonzero(n >= max(8, DENSE * len(ids)))
        self.dense = np.full(len(block.vocab), -1, np.int32)
        self.dense[there[often]] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(ids)), np.float32)  # impacts are below 2**18
        where = np.repeat(self.dense[there], n)
        some = np.flatnonzero(where >= 0)
        self.rows[where[some], d[some]] = impact[some]
        self.most = self.rows.max(axis=1, initial=0.0).astype(float)

    def scores(self, block: Block, counted: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(query, dense array of its scores): each of its terms scatters its weighted postings. ``counted``: terms weigh as often as the query has them."""
        packed, n_docs, bits, low = self.packed, len(self.ids), np.uint32(DOC_BITS), np.uint32(SHARD_DOCS - 1)
        first, last = self.begin[:-1][block.term], self.begin[1:][block.term]
        row = self.dense[block.term]
        sparse = (last > first) & (row < 0)
        weight = block.qtf.astype(float) if counted else np.ones(len(row))
        wide = None
        for base in range(0, len(block.ids), CHUNK):
            top = min(base + CHUNK, len(block.ids))
            mine = slice(block.at[base], block.at[top])
            use = np.flatnonzero(row[mine] >= 0) + mine.start
            ask = np.zeros((top - base, len(self.rows)))
            ask[np.searchsorted(block.at, use, side="right") - 1 - base, row[use]] = weight[use]
            if (ask @ self.most).max(initial=0.0) < 1 << 24:
                dense = (ask.astype(np.float32) @ self.rows).astype(float)
            else:
                wide = self.rows.astype(float) if wide is None else wide
                dense = ask @ wide
            for i in range(base, top):
                lo, hi = block.at[i], block.at[i + 1]
                keep = sparse[lo:hi]
                a, z = first[lo:hi][keep], last[lo:hi][keep]
                score = dense[i - base]
                if len(a):
                    v = np.concatenate([packed[x:y] for x, y in zip(a.tolist(), z.tolist())])
                    w = (v >> bits).astype(np.float64)
                    if counted:
                        q = block.qtf[lo:hi][keep]
                        if q.max() > 1:
                            w *= np.repeat(q, z - a)
                    score = score + np.bincount(v & low, w, n_docs)
                if lo < hi:
                    yield i, score


def shards(it: Iterator[pa.RecordBatch], block: Block, idf: np.ndarray, mean: float) -> Iterator[tuple[int, Shard]]:
    """(number, shard) of an Arrow stream of the columns ``shard`` and _ARRAYS."""
    for b in it:
        for k in range(b.num_rows):
            number, *row = (c[k].as_py() for c in b.columns)
            yield number, Shard(row, block, idf, mean)


COLUMNS = ("shard", *_ARRAYS)
