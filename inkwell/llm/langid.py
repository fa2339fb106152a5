"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum, over all ways to cut it into pieces, of the
product of their probabilities: the forward algorithm. It is trained by
expectation maximisation (forward and backward) on labelled text. A text's
score is the sum over its words' log probabilities. All words of a slice of
texts go through the recursion at once, each different word once. A word of any
length is summed whole; the sums of long words are scaled as they go.

Words are those of ``textvec`` in lower case; pieces with upper-case letters,
control pieces and byte pieces are left out. A character that no piece covers
costs ``UNKNOWN`` in every language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import textvec as tv
from inkwell.llm.common import BROADCAST_ROWS, lower_text
from inkwell.llm.storage import prepare

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled documents of a language that training sees at most, by the hash of their id; all texts are scored whole.
TRAIN_DOCS = 300
ROUNDS = 4
FLOOR = 1e-7  # share of each piece that a language doesn't have
UNKNOWN = 1e-8
SCALED = 32  # bytes; sums over longer words are scaled on the way, so that none gets too small (a byte costs 1e-8 at worst)
ALONE = 1024  # bytes; a longer word goes through the recursion alone
CELLS = 1 << 23  # sums that are held at once
_SLICE = 4 * tv.SLICE_BYTES


def pieces(path: str = VOCABULARY) -> tuple[list[bytes], list[bool]]:
    """(bytes, begins a word) of the usable pieces of a sentencepiece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        s = sp.id_to_piece(i)
        start = s.startswith("▁")
        s = s[1:] if start else s
        if s == s.lower() and "▁" not in s and (s or start):
            out[s.encode(), start] = None
    keys = sorted(out)
    return [k[0] for k in keys], [k[1] for k in keys]


class Pieces:
    """Lookup of byte spans among inner pieces and among word-initial pieces."""

    def __init__(self, names: list[bytes], starts: list[bool]):
        self.n = len(names)
        self.longest = max(map(len, names))
        h = np.array([self._hash(s) for s in names], np.int64)
        start = np.array(starts)
        full = np.array([len(s) > 0 for s in names])
        self.bare = int(np.flatnonzero(start & ~full)[0]) if (start & ~full).any() else -1
        self.inner_ids, self.first_ids = np.flatnonzero(~start & full), np.flatnonzero(start & full)
        self.inner, self.first = tv.TermTable(h[self.inner_ids]), tv.TermTable(h[self.first_ids])
        self.lengths = sorted({len(s) for s in names if s})

    @staticmethod
    def _hash(s: bytes) -> int:
        buf = np.frombuffer(s, np.uint8)
        return int(tv.span_hash(tv.prefix_hash(buf), np.array([0]), np.array([len(buf)]))[0] >> np.uint64(64 - tv.TERM_BITS))

    def spans(self, sums: np.ndarray, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> list[list[tuple]]:
        """For each end position j (from 1): (words, begin, piece ids) of the pieces that end there; -1 is an unknown character."""
        out: list[list[tuple]] = [[] for _ in range(int(lens.max(initial=0)) + 1)]
        lead = (buf & 0xC0) != 0x80  # first byte of a character
        for j in range(1, len(out)):
            act = np.flatnonzero(lens >= j)
            s = starts[act]
            end = s + j
            whole = np.flatnonzero((lens[act] == j) | lead[np.minimum(end, len(buf) - 1)])
            act, s, end = act[whole], s[whole], end[whole]
            if not len(act):
                continue
            for k in self.lengths:
                if k > j:
                    break
                h = (tv.span_hash(sums, end - k, end) >> np.uint64(64 - tv.TERM_BITS)).astype(np.int64)
                got = self.inner.find(h)
                hit = np.flatnonzero(got >= 0)
                if len(hit):
                    out[j].append((act[hit], j - k, self.inner_ids[got[hit]], False))
                if k == j:
                    got = self.first.find(h)
                    hit = np.flatnonzero(got >= 0)
                    if len(hit):
                        out[j].append((act[hit], 0, self.first_ids[got[hit]], True))
            for k in (1, 2, 3, 4):  # the last character alone
                if k <= j:
                    one = lead[end - k]
                    for m in range(1, k):
                        one = one & ~lead[end - m]
                    hit = np.flatnonzero(one)
                    if len(hit):
                        out[j].append((act[hit], j - k, None, False))
        return out

    def forward(self, spans: list[list[tuple]], prob: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, words, languages) sums over all segmentations of each prefix, and the logarithms of their scales; prob: languages x pieces."""
        top = len(spans)
        alpha, scale = np.zeros((top, n, len(prob))), np.zeros((top, n, len(prob)))
        alpha[0] = prob[:, self.bare] if self.bare >= 0 else 1.0
        p = prob.T
        now = np.zeros((n, len(prob)))
        for j in range(1, top):
            for act, i, ids, first in spans[j]:
                if first:
                    alpha[j, act] += p[ids] * np.exp(-now[act])
                else:
                    alpha[j, act] += alpha[i, act] * (UNKNOWN if ids is None else p[ids])
            scale[j] = now
            if j % 8 == 0 and top > SCALED + 1:  # what later positions look back to
                lo = max(0, j - self.longest - 3)
                most = alpha[lo : j + 1].max(axis=0)
                most[most <= 0] = 1.0
                alpha[lo : j + 1] /= most
                scale[lo : j + 1] += np.log(most)
                now = now + np.log(most)
        return alpha, scale

    def alone(self, sums: np.ndarray, buf: np.ndarray, start: int, n: int, prob: np.ndarray) -> np.ndarray:
        """Log probabilities (languages) of one long word: all its pieces are looked up at once, then summed from left to right."""
        lead = np.flatnonzero((buf[start : start + n] & 0xC0) != 0x80)
        ends = np.append(lead[1:], n)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for k in self.lengths:
            at = ends[ends >= k]
            h = (tv.span_hash(sums, start + at - k, start + at) >> np.uint64(64 - tv.TERM_BITS)).astype(np.int64)
            got = self.inner.find(h)
            for e, i in zip(at[got >= 0].tolist(), self.inner_ids[got[got >= 0]].tolist()):
                found[e].append((e - k, i))
        first = {}
        for k in self.lengths:
            if k <= n:
                h = (tv.span_hash(sums, np.array([start]), np.array([start + k])) >> np.uint64(64 - tv.TERM_BITS)).astype(np.int64)
                got = int(self.first.find(h)[0])
                if got >= 0:
                    first[k] = int(self.first_ids[got])
        p = prob.T
        alpha = {0: p[self.bare].copy() if self.bare >= 0 else np.ones(len(prob))}
        now, before = np.zeros(len(prob)), dict(zip(ends.tolist(), lead.tolist()))
        for count, e in enumerate(ends.tolist()):
            a = alpha[before[e]] * UNKNOWN
            for i, k in found[e]:
                if i in alpha:
                    a = a + alpha[i] * p[k]
            if e in first:
                a = a + p[first[e]] * np.exp(-now)
            alpha[e] = a
            if count % 8 == 7:
                alpha = {k: v for k, v in alpha.items() if k >= e - self.longest}
                most = np.maximum.reduce(list(alpha.values()))
                most[most <= 0] = 1.0
                alpha = {k: v / most for k, v in alpha.items()}
                now = now + np.log(most)
        return np.log(np.maximum(alpha[n], 1e-300)) + now

    def backward(self, spans: list[list[tuple]], prob: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Unscaled, for words of up to SCALED bytes."""
        top = len(spans)
        beta = np.zeros((top, len(lens), len(prob)))
        beta[lens, np.arange(len(lens))] = 1.0
        p = prob.T
        for j in range(top - 1, 0, -1):
            for act, i, ids, first in spans[j]:
                if ids is None:
                    beta[i, act] += beta[j, act] * UNKNOWN
                elif not first:
                    beta[i, act] += beta[j, act] * p[ids]
        return beta


def distinct_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths of distinct words; which of them each word is; row of each word; prefix hashes)."""
    starts, ends = tv.word_spans(buf, off)
    row = np.searchsorted(off, starts, side="right") - 1
    lens = ends - starts
    sums = tv.prefix_hash(buf)
    _, first, inv = np.unique(tv.span_hash(sums, starts, ends), return_index=True, return_inverse=True)
    return starts[first], lens[first], inv, row, sums


def _short(word: bytes) -> Iterator[bytes]:
    """A word in pieces of up to SCALED bytes, cut between characters."""
    while len(word) > SCALED:
        k = SCALED
        while k > 1 and word[k] & 0xC0 == 0x80:
            k -= 1
        yield word[:k]
        word = word[k:]
    yield word


@dataclass
class Model:
    languages: list[str]
    prob: np.ndarray
    pieces: Pieces

    def scores(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages log probabilities, words of each row)."""
        starts, lens, inv, row, sums = distinct_words(buf, off)
        n = len(off) - 1
        if not len(starts) or not self.languages:
            return np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        order = np.argsort(lens, kind="stable")
        sizes = lens[order]
        log = np.zeros((len(starts), len(self.languages)))
        lo = 0
        while lo < len(order):  # groups of words of about one length
            size = int(lens[order[lo]])
            if size > ALONE:
                log[order[lo]] = self.pieces.alone(sums, buf, int(starts[order[lo]]), size, self.prob)
                lo += 1
                continue
            hi = int(np.searchsorted(sizes, size + max(4, size // 8), side="right"))
            hi = min(hi, lo + 20_000, lo + max(1, CELLS // (size * 9 // 8 + 5) // len(self.languages)))
            g = order[lo:hi]
            spans = self.pieces.spans(sums, buf, starts[g], lens[g])
            alpha, scale = self.pieces.forward(spans, self.prob, len(g))
            log[g] = np.log(np.maximum(alpha[lens[g], np.arange(len(g))], 1e-300)) + scale[lens[g], np.arange(len(g))]
            lo = hi
        out = np.stack([np.bincount(row, log[inv, k], n) for k in range(log.shape[1])], 1)
        return out, np.bincount(row, minlength=n)


def fit(texts: pa.Array, langs: list[str], vocabulary: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation from equal shares, for each language on its own texts (lower-cased). For this, words of over SCALED bytes are cut; scoring sums them whole."""
    table = Pieces(*pieces(vocabulary))
    names = sorted(set(langs))
    prob = np.full((len(names), table.n), 1.0 / table.n)
    for k, name in enumerate(names):
        mine = texts.filter(pa.array([x == name for x in langs]))
        seen: dict[bytes, int] = {}
        for _, _, buf, off in tv.slices(mine, _SLICE):
            starts, lens, inv, _, _ = distinct_words(buf, off)
            for s, n, c in zip(starts.tolist(), lens.tolist(), np.bincount(inv).tolist()):
                for w in _short(buf[s : s + n].tobytes()):
                    seen[w] = seen.get(w, 0) + c
        if not seen:
            continue
        words = sorted(seen, key=lambda w: (len(w), w))
        count = np.array([seen[w] for w in words], float)
        lens = np.array([len(w) for w in words])
        buf = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lens) - lens
        sums = tv.prefix_hash(buf)
        groups, lo = [], 0
        while lo < len(words):
            hi = min(int(np.searchsorted(lens, lens[lo] + 4, side="right")), lo + 20_000)
            groups.append((lo, hi, table.spans(sums, buf, starts[lo:hi], lens[lo:hi])))
            lo = hi
        for _ in range(rounds):
            p = prob[k : k + 1]
            got = np.zeros(table.n)
            for lo, hi, spans in groups:
                alpha, beta = table.forward(spans, p, hi - lo)[0][:, :, 0], table.backward(spans, p, lens[lo:hi])[:, :, 0]
                z = np.maximum(alpha[lens[lo:hi], np.arange(hi - lo)], 1e-300)
                share = count[lo:hi] / z
                if table.bare >= 0:
                    got[table.bare] += (share * p[0, table.bare] * beta[0]).sum()
                for j in range(1, len(spans)):
                    for act, i, ids, first in spans[j]:
                        if ids is not None:
                            before = 1.0 if first else alpha[i, act]
                            np.add.at(got, ids, share[act] * before * p[0, ids] * beta[j, act])
            prob[k] = got / max(got.sum(), 1e-300) + FLOOR
            prob[k] /= prob[k].sum()
    used = np.flatnonzero((prob > 2 * FLOOR).any(0))
    keep = np.zeros(table.n, bool)
    keep[used] = True
    if table.bare >= 0:
        keep[table.bare] = True
    names_, starts_ = pieces(vocabulary)
    at = np.flatnonzero(keep)
    small = Pieces([names_[i] for i in at], [starts_[i] for i in at]) if len(names) and len(at) else table
    return Model(names, prob[:, at] if small is not table else prob, small)


def train(docs: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """Fits on at most TRAIN_DOCS documents of each value of ``lang``, by the hash of doc_id; null languages, ids and texts aren't used."""
    from pyspark.sql import Window

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and lang is not null and text is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("r", rank).where(F.col("r") <= TRAIN_DOCS).select("doc_id").distinct()
    assert TRAIN_DOCS * 500 <= BROADCAST_ROWS  # so the sample can be broadcast
    got = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("text").alias("text")).toArrow().sort_by("doc_id")
    return fit(lower_text(got["text"]), got["lang"].to_pylist(), vocabulary)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, margin) of every row.

    ``margin`` is the lead over the second language in nats per word, 0 with
    one language only. Null and wordless texts get a null language and margin;
    ties go to the first language by name; a null id is reported as null;
    repeated rows give equal rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, None], object)
        for b in it:
            lang, margin = [], []
            for lo, hi, buf, off in tv.slices(lower_text(b.column(1)), _SLICE):
                s, n = model.scores(buf, off)
                if not model.languages:
                    lang += [None] * (hi - lo)
                    margin += [None] * (hi - lo)
                    continue
                top = s.argmax(1)
                two = np.sort(s, 1)
                lead = (two[:, -1] - two[:, -2]) / np.maximum(n, 1) if s.shape[1] > 1 else np.zeros(hi - lo)
                lang += names[np.where(n > 0, top, len(names) - 1)].tolist()
                margin += [float(x) if c else None for x, c in zip(lead, n)]
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(margin, pa.float64())], ["doc_id", "language", "margin"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, language string, margin double")
