"""Near-duplicate removal: SimHash fingerprints, covering locality-sensitive hashing.

A fingerprint has 256 bits; each distinct term of a document has one vote on
each. A cover cuts the bits into words. For a word and a radius rho, bit i gets
a vector m(i) of rho+1 bits, and for every nonzero v there is a table keyed by
the bits with <m(i), v> odd. The m(i) of at most rho differing bits span less
than the whole space, so some v is orthogonal to all of them and the pair has
the same key in that table. Two fingerprints within words*(rho+1)-1 bits have a
word with at most rho differing bits, so they meet for certain. All covers in
``COVERS`` reach ``ACCEPT``, so every pair within ``ACCEPT`` bits is found and
linked, whichever is taken; which one is cheapest depends on the number of
fingerprints. Groups are the connected components.

Tables travel in units of up to three that share some bits of their keys: a
fingerprint is sent once to the unit's bucket of those bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import textvec as tv
from inkwell.llm.common import ints, lower_text, without_ids
from inkwell.llm.storage import Written, prepare

PARTS = 4  # 64-bit words of a fingerprint
ACCEPT = 38
COVERS = ((8, 4), (7, 5), (6, 6), (5, 7), (4, 9))  # (words, rho)
LONG = 48  # bytes
_ALL_PAIRS = 2048  # runs of equal keys up to this size are compared pair by pair
_ROWS = 50_000  # fingerprints that are compared at once, whole buckets
_REDUCE = 1_000_000  # links held before they are reduced to a forest


class Cover:
    """The masks of a cover: of each table its word and the bits of its key."""

    def __init__(self, words: int, rho: int, share: int = 3, bits: int = 64 * PARTS):
        self.words, self.rho = words, rho
        self.radius = words * (rho + 1) - 1
        self.cuts = [bits * p // words for p in range(words + 1)]
        self.units: list[tuple[int, np.uint64, list[np.uint64]]] = []  # word, shared bits, masks of its tables
        rng = np.random.default_rng(7)
        top = 1 << (rho + 1)
        for p in range(words):
            w = self.cuts[p + 1] - self.cuts[p]
            m = np.concatenate([rng.permutation(top - 1) + 1 for _ in range(-(-w // (top - 1)))])[:w]
            masks = {v: int(np.bitwise_or.reduce(np.where(np.bitwise_count(m & v) & 1, np.uint64(1) << np.arange(w, dtype=np.uint64), np.uint64(0)))) for v in range(1, top)}
            left = list(masks)
            while left:
                mine = [left.pop(0)]
                both = masks[mine[0]]
                while left and len(mine) < share:
                    v = max(left, key=lambda x: ((both & masks[x]).bit_count(), -x))
                    if not both & masks[v]:
                        break
                    left.remove(v)
                    mine.append(v)
                    both &= masks[v]
                self.units.append((p, np.uint64(both), [np.uint64(masks[v]) for v in mine]))

    @property
    def tables(self) -> int:
        return self.words * ((2 << self.rho) - 1)

    def word(self, fps: np.ndarray, p: int) -> np.ndarray:
        a, b = self.cuts[p], self.cuts[p + 1]
        k, off = divmod(a, 64)
        out = fps[:, k] >> np.uint64(off)
        if b > 64 * (k + 1):
            out = out | (fps[:, k + 1] << np.uint64(64 - off))
        return out & np.uint64((1 << (b - a)) - 1)


def choose(n: int, accept: int = ACCEPT) -> Cover:
    """The cheapest cover for n fingerprints among those that reach ``accept``: tables cost by rows, and by the pairs with equal keys (measured about eight times those of even bits)."""
    fit = [c for c in COVERS if c[0] * (c[1] + 1) - 1 >= accept]
    if not fit:
        raise ValueError(f"no cover reaches {accept} bits")
    words, rho = min(fit, key=lambda c: c[0] * ((2 << c[1]) - 1) * (400 + 240 * n / 2 ** (32 * PARTS / c[0] + 1)))
    wide = 64 * PARTS / words
    share = next((g for g in (3, 2) if n / 2 ** (wide / 2**g) <= 1 << 18), 1)
    return Cover(words, rho, share)


def votes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term of each word, first of each row and the end); a word of over ``LONG`` bytes, as scripts without spaces have them, counts as its runs of three characters."""
    starts, ends = tv.word_spans(buf, off)
    long = ends - starts > LONG
    if long.any():
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        lo, hi = np.searchsorted(lead, starts[long]), np.searchsorted(lead, ends[long])
        at = tv.ragged(lo, np.maximum(hi - lo - 2, 0))
        stop = np.append(lead, len(buf))[at + 3]
        starts, ends = np.concatenate((starts[~long], lead[at])), np.concatenate((ends[~long], stop))
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    terms = (tv.span_hash(tv.prefix_hash(buf), starts, ends) >> np.uint64(64 - tv.TERM_BITS)).astype(np.int64)
    return terms, np.searchsorted(starts, off)


def fingerprints(column: pa.Array, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts fingerprint words, mask of rows with a word) of lower-cased texts."""
    got, there = [], []
    for lo, hi, buf, off in tv.slices(column):
        n = hi - lo
        row, term, _ = tv.counted(*votes(buf, off))
        first = np.searchsorted(row, np.arange(n + 1))
        has = np.diff(first) > 0
        fp = np.zeros((n, parts), np.uint64)
        if has.any():
            at, size = first[:-1][has], np.diff(first)[has]
            for p in range(parts):
                h = tv.mix(term.astype(np.uint64) * np.uint64(2 * p + 3) + np.uint64(0x51ED270B * (p + 1)))
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
                yes = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
                fp[has, p] = np.packbits(yes * 2 > size[:, None], axis=1).view(np.uint64).ravel()
        got.append(fp)
        there.append(has)
    if not got:
        return np.empty((0, parts), np.uint64), np.empty(0, bool)
    return np.concatenate(got), np.concatenate(there)


def node_ids(fps: np.ndarray) -> np.ndarray:
    """One 64-bit name per fingerprint; at 10**9 fingerprints two share a name with a chance of 3 %."""
    h = np.zeros(len(fps), np.uint64)
    for p in range(fps.shape[1]):
        h = tv.mix((h * np.uint64(0x9E3779B97F4A7C15)) ^ fps[:, p])
    return h.view(np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _cluster(fps: np.ndarray, accept: int) -> np.ndarray:
    """Component (its first row) of each row, by a breadth-first search that looks only at rows not yet reached."""
    label = np.full(len(fps), -1, np.int64)
    rest = np.arange(len(fps))
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        label[root] = root
        while queue and len(rest):
            near = distance(fps[rest], fps[queue.pop()]) <= accept
            new = rest[near]
            label[new] = root
            rest = rest[~near]
            queue.extend(new.tolist())
        # what is left in the queue has nothing more to reach
    return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same rows with fewer links: the least row of each component and every other one."""
    rows, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(rows))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(rows)))
    return rows[label[other]], rows[other]


def links(fps: np.ndarray, key: np.ndarray, accept: int = ACCEPT) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that join everything within ``accept`` bits among rows with equal keys."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    a, b, held = [], [], 0
    many = np.repeat(size, size)
    m = fps[order]
    left = many - (np.arange(len(key)) - np.repeat(start, size))  # rows from here to the end of the run
    active = np.flatnonzero((many > 1) & (many <= _ALL_PAIRS))
    k = 0
    while True:
        k += 1
        active = active[left[active] > k]
        if not len(active):
            break
        far = np.bitwise_count(m[active, 0] ^ m[active + k, 0])
        for p in range(1, m.shape[1] - 1):
            far = far + np.bitwise_count(m[active, p] ^ m[active + k, p])
        near = active[far <= accept]
        near = near[distance(m[near], m[near + k]) <= accept]
        if len(near):
            a.append(near)
            b.append(near + k)
            held += len(near)
            if held > _REDUCE:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
    for s, n in zip(start[size > _ALL_PAIRS].tolist(), size[size > _ALL_PAIRS].tolist()):
        root = s + _cluster(m[s : s + n], accept)
        rows = np.arange(s, s + n)
        a.append(root[root != rows])
        b.append(rows[root != rows])
    if not a:
        e = np.empty(0, np.int64)
        return e, e
    x, y = np.concatenate(a), np.concatenate(b)
    if len(x) > len(fps):
        x, y = forest(x, y)
    return order[x], order[y]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, node) of documents that have an id and a word.

    One pass: a step of Python on top of another in a task would take a second
    worker for each core, and workers stay with their memory when they idle.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps, has = fingerprints(lower_text(b.column(1)))
            ids, known = ints(b.column(0))
            keep = has & known
            raw = np.ascontiguousarray(fps[keep])
            n = len(raw)
            col = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 8 * PARTS).astype(np.int32)), pa.py_buffer(raw.tobytes())])
            yield pa.record_batch([pa.array(ids[keep]), col, pa.array(node_ids(raw))], ["doc_id", "fp", "node"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp binary, node long")


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint64).reshape(-1, parts)


def edges(fps: DataFrame, accept: int = ACCEPT, cover: Cover | None = None) -> DataFrame:
    """(a, b) node names that link near fingerprints; ``fps`` has distinct values in column fp."""
    n_rows = fps.count()
    cover = cover or choose(n_rows, accept)
    wide = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows * len(cover.units) * 8 * PARTS // 32_000_000)

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole arrays travel as one row
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            m = np.concatenate(held)
            words = [cover.word(m, p) for p in range(cover.words)]
            for u, (p, shared, _) in enumerate(cover.units):
                sub = words[p] & shared
                order = np.argsort(sub, kind="stable")
                sub, mm = sub[order], m[order]
                cut = np.flatnonzero(np.concatenate(([True], sub[1:] != sub[:-1])))
                bucket = ((tv.mix(sub[cut]) >> np.uint64(24)).astype(np.int64)) | (u << 40)
                yield pa.record_batch([pa.array(bucket), pa.array([mm[x:y].tobytes() for x, y in zip(cut, [*cut[1:], len(sub)])], pa.binary())], ["bucket", "payload"])

        for b in it:
            if b.num_rows:
                held.append(_matrix(b.column(0), PARTS))
            if sum(map(len, held)) > 200_000:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        unit, last, size = -1, -1, 0
        for b in it:  # sorted by bucket
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (k >> 40 != unit or (k != last and size > _ROWS)):
                    yield compare(held, unit)
                    held, size = [], 0
                unit, last, size = k >> 40, k, size + len(raw) // (8 * PARTS)
                held.append(raw)
        if held:
            yield compare(held, unit)

    def compare(held: list[bytes], unit: int) -> pa.RecordBatch:
        m = np.frombuffer(b"".join(held), np.uint64).reshape(-1, PARTS)
        p, _, masks = cover.units[unit]
        word = cover.word(m, p)
        got = [links(m, word & mask, accept) for mask in masks]
        x, y = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        if len(x):
            x, y = forest(x, y)
        a, b = node_ids(m[x]), node_ids(m[y])
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    sent = fps.select("fp").mapInArrow(send, "bucket long, payload binary")
    return sent.repartition(wide, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long").where("a <> b").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of the edge table (a, b): alternating large and small stars.

    Each round is written to the shared folder, so a lost executor costs one round at most.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = Written(pairs, "edges")
    was = mark(now.df)
    while was[0]:
        e = now.df
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        mid = Written(large, "edges")
        e2 = mid.df.select(F.col("b").alias("n"), F.col("a").alias("s"))
        least = e2.groupBy("n").agg(F.min("s").alias("m"))
        joined = e2.join(least, "n")
        small = joined.select(F.col("m").alias("a"), F.col("s").alias("b")).unionByName(joined.select(F.col("m").alias("a"), F.col("n").alias("b"))).where("a < b").distinct()
        new = Written(small, "edges")
        now.drop()
        mid.drop()
        now, got = new, mark(new.df)
        if got == was:
            break
        was = got
    return now.df.select(F.col("b").alias("node"), F.col("a").alias("root"))


def duplicates(docs: DataFrame, accept: int = ACCEPT, cover: Cover | None = None) -> DataFrame:
    """(doc_id, duplicate_of) of each document that goes; the smallest id of a group stays.

    Fingerprints within ``accept`` bits are in one group, and so are all that a
    chain of such links joins. The rows of one id are one document: their groups
    are joined too, so the id that stays stands for all their texts. Documents
    without an id or without a word are in no group. Rows with one id and equal
    fingerprints are one row. An empty table gives no rows; other columns of
    ``docs`` aren't read.
    """
    prepare(docs.sparkSession)
    sig = Written(signatures(docs), "signatures")
    groups = Written(sig.df.groupBy("fp", "node").agg(F.min("doc_id").alias("low")), "nodes")
    found = edges(groups.df, accept, cover)
    # different fingerprints of one id
    again = sig.df.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    own = sig.df.join(again, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    root = components(found.unionByName(own).distinct())
    node = groups.df.select("node", "low").join(root, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    keep = node.groupBy("root").agg(F.min("low").alias("duplicate_of"))
    kept = node.join(keep, "root").select("node", "duplicate_of")
    return sig.df.select("doc_id", "node").join(kept, "node").where("doc_id <> duplicate_of").select("doc_id", "duplicate_of").distinct()


def dedup(docs: DataFrame, accept: int = ACCEPT, cover: Cover | None = None) -> DataFrame:
    """``docs`` with one document of each group; columns unchanged.

    Of rows that repeat an id one stays, chosen by the hash of its text, ties by
    the text and then by a hash of the row. Rows with a null id and rows without a word stay.
    """
    gone = Written(duplicates(docs, accept, cover), "gone")
    kept = without_ids(docs, gone.df.select("doc_id"))
    again = Written(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.df.isEmpty():
        return kept
    # a partial minimum, so that many rows of one id don't meet in a task
    whole = F.struct(*docs.columns)
    by = F.struct(F.xxhash64("text"), "text", F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]))
    one = kept.join(again.df, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, by).alias("row_")).select("row_.*")
    return without_ids(kept, again.df).unionByName(one)
