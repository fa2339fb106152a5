"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Seeds are the stated query set, the documents whose id ``ONE_IN`` divides. Every
seed is searched, with all its different words, against all rows of the corpus:
``postings`` scores each document of each shard exhaustively, so no neighbour is
lost at any size. A document that several seeds retrieve is used once: the seed
that it matches best gets it, by score / sqrt(the seed's score of itself), which
keeps long seeds from drawing everything. Equal matches go by a hash of both
ids, so copies spread over the seeds among them, then by the smaller seed.

A seed and the neighbours that no other seed uses are its list, best match
first. They fill windows greedily: each goes into the seed's first window that
has room for it, the first of which begins with the seed; if none has, it opens
one more. So every document is placed, also those that would not have fit the
seed's own window. Documents that match no seed follow by id in windows without one.

A list may be long; it is cut into pieces of ``PIECE`` documents, numbered over
the sorted rows by counts of the partitions, so no task holds a whole list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import postings as P
from inkwell.llm import textvec as tv
from inkwell.llm.common import ints
from inkwell.llm.storage import Written

WINDOW = 4096  # words of a window
ONE_IN = 100
PIECE = 4096  # documents of a list that are packed together
SCHEMA = "seed_doc_id long, piece long, window int, doc_ids array<long>, starts array<int>, n_words array<int>, total_words int"
_MATCH = "shard long, row int, doc_id long, n int, seed long, score double, hash long"


def draw(doc: np.ndarray, seed: int) -> np.ndarray:
    """What decides between equal matches."""
    return tv.mix(doc.view(np.uint64) ^ tv.mix(np.array([seed], np.int64).view(np.uint64))).view(np.int64)


def own_scores(block: P.Block, idf: np.ndarray, mean: float) -> np.ndarray:
    """Each seed's score of itself."""
    impact = np.floor(1000 * (idf[block.term] * P.part(block.qtf.astype(float), np.repeat(block.lens, np.diff(block.at)), mean)))
    return np.bincount(np.repeat(np.arange(len(block.ids)), np.diff(block.at)), impact, len(block.ids))


def matches(index: DataFrame, block: P.Block) -> DataFrame:
    """For every document its best seed of the block, and how well it matches."""
    sc = index.sparkSession.sparkContext
    stats = P.Statistics(index, block)
    shared = sc.broadcast((block, stats.idf, stats.mean, own_scores(block, stats.idf, stats.mean)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, idf, mean, own = shared.value
        for number, shard in P.shards(it, block, idf, mean):
            n = len(shard.ids)
            best, who, luck = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
            for i, score in shard.scores(block, False):
                if own[i] <= 0:
                    continue
                score /= np.sqrt(own[i])
                at = np.flatnonzero((score >= best) & (score > 0))
                new = draw(shard.ids[at], block.ids[i])
                wins = (score[at] > best[at]) | (new > luck[at]) | (who[at] < 0)
                at = at[wins]
                best[at], who[at], luck[at] = score[at], i, new[wins]
            some = who >= 0
            seed = np.array(block.ids or [0], np.int64)[np.maximum(who, 0)]
            keep = np.flatnonzero(shard.sizes > 0)
            yield pa.record_batch(
                [pa.array(np.full(len(keep), number)), pa.array(keep.astype(np.int32)), pa.array(shard.ids[keep]), pa.array(shard.sizes[keep]), pa.array(seed[keep], mask=~some[keep]), pa.array(best[keep]), pa.array(luck[keep])],
                ["shard", "row", "doc_id", "n", "seed", "score", "hash"],
            )

    return index.select(*P.COLUMNS).mapInArrow(run, _MATCH)


def fill(sizes: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """(window of each size, number of windows): each goes into the first window that has room."""
    rooms, n, out = np.zeros(64, np.int64), 0, np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        at = int(np.argmax(rooms[:n] >= size)) if n else 0
        if not n or rooms[at] < size:
            at, n = n, n + 1
            if n > len(rooms):
                rooms = np.concatenate((rooms, np.zeros(len(rooms), np.int64)))
            rooms[at] = window
        rooms[at] -= size
        out[k] = at
    return out, n


def pack(docs: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, piece: int = PIECE) -> DataFrame:
    """One row per window: its seed (null: none), the piece of the seed's list, the window's number in it, and the documents with first word and word count.

    Each document row with an id and a word is placed exactly once (a text
    longer than a window in consecutive pieces: its full windows hold it alone,
    the rest is packed). Rows with a null id, and null or wordless texts, hold
    nothing to place and are left out. Rows that repeat an id are placed each;
    those that repeat a seed's id come first in its list, and the least of their
    texts is the query. Equal matches of a seed are ordered by doc_id, then by
    word count. No seed at all: all documents follow by id. An empty table gives
    no windows. Other columns aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = P.build(docs)
    seeds = docs.where((F.col("doc_id") % one_in == 0) & F.col("text").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id")
    found, several = None, False
    for block in P.blocks(seeds):
        got = Written(matches(index.df, block), "matches").df
        several = found is not None
        found = got if found is None else found.unionByName(got)
    if several:
        top = F.max_by(F.struct("doc_id", "n", "seed", "score"), F.struct("score", "hash", -F.col("seed")))
        found = found.groupBy("shard", "row").agg(top.alias("x")).select("x.*")
    index.drop()
    # a row of a seed's id belongs to that seed
    own = F.col("doc_id") % one_in == 0
    rows = found.select("doc_id", "n", F.when(own, F.col("doc_id")).otherwise(F.col("seed")).alias("seed"), F.when(own, F.lit(0)).otherwise(F.lit(1)).alias("later"), F.when(F.col("seed").isNull() | own, F.lit(0.0)).otherwise(-F.col("score")).alias("score"))
    by = [F.col("seed").asc_nulls_first(), F.col("later"), F.col("score"), F.col("doc_id"), F.col("n")]

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, last, at = TaskContext.get().partitionId(), 0, None, 0
        for b in it:
            seed, known = ints(b.column(2))
            pos = np.arange(b.num_rows)
            new = np.ones(b.num_rows, bool)
            new[1:] = (seed[1:] != seed[:-1]) | (known[1:] != known[:-1])
            if b.num_rows:
                new[0] = last is None or last != (seed[0], known[0])
                start = np.maximum.accumulate(np.where(new, pos, -1))
                runs = np.where(start >= 0, pos - start, pos + run)
                run, last = int(runs[-1]) + 1, (seed[-1], known[-1])
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(pos + at), pa.array(runs)], ["doc_id", "n", "seed", "part", "at", "run"])
                at += b.num_rows

    listed = Written(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(number, "doc_id long, n int, seed long, part int, at long, run long"), "listed")
    ends = listed.df.groupBy("part").agg(F.min_by(F.struct("seed"), "at").alias("a"), F.max_by(F.struct("seed", "run"), "at").alias("z")).orderBy("part").collect()
    before, carried = {}, None  # rows of a partition's first list that earlier partitions have
    for e in ends:
        before[e.part] = (e.a.seed, carried[1] if carried and carried[0] == e.a.seed else 0)
        carried = (e.z.seed, e.z.run + 1 + (before[e.part][1] if e.z.seed == e.a.seed else 0))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            seed, known = ints(b.column(2))
            run = b.column(5).to_numpy().copy()
            part = b.column(3).to_numpy()
            for p in np.unique(part).tolist():
                first, extra = before[p]
                here = (part == p) & (~known if first is None else known & (seed == first))
                run[here] += extra
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(run // piece), pa.array(run % piece)], ["doc_id", "n", "seed", "piece", "pos"])

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in it:  # sorted by seed and piece
            seed, known = ints(b.column(2))
            no = b.column(3).to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (known[1:] != known[:-1]) | (no[1:] != no[:-1])))) if b.num_rows else []
            for lo, hi in zip(edge, [*edge[1:], b.num_rows]):
                key = (seed[lo] if known[lo] else None, no[lo])
                if held and key != now:
                    yield one(held, now)
                    held = []
                now = key
                held.append(b.slice(int(lo), int(hi - lo)))
        if held:
            yield one(held, now)

    def one(held: list[pa.RecordBatch], key: tuple) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, n = t["doc_id"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        whole, rest = np.divmod(n, window)
        full = np.flatnonzero(whole)
        use = np.flatnonzero(rest)
        at, count = fill(rest[use], window)
        order = use[np.argsort(at, kind="stable")]
        alone = np.repeat(full, whole[full])
        lens = np.concatenate((np.bincount(at, minlength=count), np.ones(len(alone), np.int64)))
        off = pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32))
        doc = np.concatenate((ids[order], ids[alone]))
        start = np.concatenate((whole[order] * window, tv.ragged(np.zeros(len(full), np.int64), whole[full]) * window)).astype(np.int32)
        words = np.concatenate((rest[order], np.full(len(alone), window))).astype(np.int32)
        total = np.add.reduceat(words, off.to_numpy()[:-1]) if len(lens) else words
        k = len(lens)
        return pa.record_batch(
            [pa.array([key[0]] * k, pa.int64()), pa.array([key[1]] * k, pa.int64()), pa.array(np.arange(k, dtype=np.int32)), pa.ListArray.from_arrays(off, pa.array(doc)), pa.ListArray.from_arrays(off, pa.array(start)), pa.ListArray.from_arrays(off, pa.array(words)), pa.array(total.astype(np.int32))],
            ["seed_doc_id", "piece", "window", "doc_ids", "starts", "n_words", "total_words"],
        )

    pieces = listed.df.mapInArrow(cut, "doc_id long, n int, seed long, piece long, pos long")
    return pieces.repartition("seed", "piece").sortWithinPartitions("seed", "piece", "pos").mapInArrow(windows, SCHEMA)
