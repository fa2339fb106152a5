"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
the weights of its words and word beginnings, and 0 if none has a weight, so that length
alone adds nothing; a document's is the noisy-or of its sentences,
1 - prod(1 - p). Weights are trained from document labels alone, through the
noisy-or, with an L1 penalty; the sentence scores then locate what offends.

Sentences end after ``.``, ``!``, ``?`` and line ends.
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

#: Labelled documents of each class that training sees at most, taken by the hash of their id; all documents are scored.
TRAIN_TOXIC, TRAIN_CLEAN = 5000, 5000
#: A word must be in so many toxic training documents to get a weight.
LEAST_DOCS = 3
#: Lengths in bytes of the word beginnings that are features beside the words.
STEMS = (4, 5, 6)
L1 = 2e-4
ROUNDS = 250
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n\r"]] = True
SENTENCES = "array<struct<sentence:int,start:int,end:int,prob:double>>"


@dataclass
class Model:
    terms: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float

    def table(self) -> tv.TermTable:
        return tv.TermTable(self.terms)


def _features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, which word it is of): each word, and its first bytes where it is longer, so that inflected forms share a feature."""
    sums = tv.prefix_hash(buf)
    shift = np.uint64(64 - tv.TERM_BITS)
    got = [(tv.span_hash(sums, starts, ends) >> shift).astype(np.int64)]
    who = [np.arange(len(starts))]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        h = tv.mix(tv.span_hash(sums, starts[long], starts[long] + n) + np.uint64(n))
        got.append((h >> shift).astype(np.int64))
        who.append(long)
    return np.concatenate(got), np.concatenate(who)


def _bags(buf: np.ndarray, off: np.ndarray, table: tv.TermTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, sentence number within the slice, feature) of each known feature of each word."""
    starts, ends = tv.word_spans(buf, off)
    terms, who = _features(buf, starts, ends)
    got = table.find(terms)
    known = np.flatnonzero(got >= 0)
    at = starts[who[known]]
    row = np.searchsorted(off, at, side="right") - 1
    sent = np.cumsum(_END[buf])[at] + row if len(at) else np.empty(0, np.int64)  # a row's end ends a sentence too
    return row, sent, got[known]


def _sentence_scores(buf: np.ndarray, off: np.ndarray, model: Model, table: tv.TermTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, sentence, prob) of sentences with a weighted word."""
    row, sent, got = _bags(buf, off, table)
    e = np.empty(0, np.int64)
    if not len(got):
        return e, e, np.empty(0)
    s, inv = np.unique(sent, return_inverse=True)
    z = np.bincount(inv, model.weights[got]) + model.bias
    srow = np.zeros(len(s), np.int64)
    srow[inv] = row
    return srow, s, 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def document_scores(buf: np.ndarray, off: np.ndarray, model: Model, table: tv.TermTable) -> np.ndarray:
    row, _, p = _sentence_scores(buf, off, model, table)
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), len(off) - 1))


def _distinct(texts: pa.Array) -> Iterator[np.ndarray]:
    """Features of each document, each once, slice by slice."""
    for lo, hi, buf, off in tv.slices(texts):
        starts, ends = tv.word_spans(buf, off)
        t, who = _features(buf, starts, ends)
        row = np.searchsorted(off, starts, side="right")[who] - 1
        order = np.argsort(row, kind="stable")
        yield tv.counted(t[order], np.searchsorted(row[order], np.arange(hi - lo + 1)))[1]


def fit(texts: pa.Array, toxic: np.ndarray, seed: int = 3) -> Model:
    """Trains on lower-cased texts with 0/1 labels; a quarter is held out for the threshold. Without both classes nothing is toxic."""
    toxic = np.asarray(toxic, float)
    if toxic.sum() < 2 or toxic.sum() > len(toxic) - 2:
        return Model(np.empty(0, np.int64), np.empty(0), -12.0, 0.5)
    held = np.random.default_rng(seed).random(len(toxic)) < 0.25
    # candidates: features of toxic training documents that clean ones have less often
    parts = [t for t in _distinct(texts.filter(pa.array((toxic > 0) & ~held)))]
    term, a = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))
    n1, n0 = max(toxic[~held].sum(), 1), max((1 - toxic[~held]).sum(), 1)
    often = a >= min(LEAST_DOCS, n1)
    term, a, b = term[often], a[often], np.zeros(int(often.sum()))
    table = tv.TermTable(term)
    for t in _distinct(texts.filter(pa.array((toxic == 0) & ~held))):
        got = table.find(t)
        b += np.bincount(got[got >= 0], minlength=len(b))
    keep = (a + 0.5) / n1 > 2 * (b + 0.5) / n0
    vocab = term[keep]
    if not len(vocab):
        return Model(np.empty(0, np.int64), np.empty(0), -12.0, 0.5)
    table = tv.TermTable(vocab)
    doc, sent, feat = [], [], []
    last = 0
    for lo, _, buf, off in tv.slices(texts):
        row, s, got = _bags(buf, off, table)
        doc.append(row + lo)
        sent.append(s + last)
        feat.append(got)
        last += int(s.max(initial=0)) + 1
    doc, sent, feat = np.concatenate(doc), np.concatenate(sent), np.concatenate(feat)
    sid, inv = np.unique(sent, return_inverse=True)
    sdoc = np.zeros(len(sid), np.int64)
    sdoc[inv] = doc
    weight_of = np.where(toxic > 0, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1)) * ~held
    w, bias = np.zeros(len(vocab)), -7.0
    rate = (a[keep] + 0.5) / n1 / ((b[keep] + 0.5) / n0)
    w += np.log(rate)  # naive Bayes start
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

    def scores() -> tuple[np.ndarray, np.ndarray]:
        z = np.bincount(inv, w[feat], len(sid)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return p, -np.expm1(np.bincount(sdoc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(toxic)))

    for step in range(1, ROUNDS + 1):
        p, doc_p = scores()
        doc_p = np.clip(doc_p, 1e-9, 1 - 1e-9)
        # d(loss)/d(log_not): for toxic (1-P)/P, for clean -1; d(log_not)/dz = -p
        up = weight_of * np.where(toxic > 0, (1 - doc_p) / doc_p, -1.0)
        gz = -up[sdoc] * p
        g = np.bincount(feat, gz[inv], len(vocab))
        gb = gz.sum()
        rate = 0.1 * (1 - step / (ROUNDS + 1))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        scale = rate / (np.sqrt(v / c2) + 1e-6)
        w = w - scale * m / c1
        w = np.sign(w) * np.maximum(np.abs(w) - scale * L1, 0)
        bias = min(-4.0, bias - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6))
    _, doc_p = scores()
    check = np.flatnonzero(held)
    if not toxic[check].sum():
        check = np.arange(len(toxic))
    # the threshold in the middle of the best F1 on held-out documents, no lower than one half
    order = check[np.argsort(-doc_p[check], kind="stable")]
    tp = np.cumsum(toxic[order])
    f1 = 2 * tp / (np.arange(1, len(order) + 1) + toxic[check].sum())
    k = int(np.argmax(f1))
    nxt = doc_p[order[k + 1]] if k + 1 < len(order) else 0.0
    used = w != 0
    return Model(vocab[used], w[used], float(bias), float(max(0.5, (doc_p[order[k]] + nxt) / 2)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most TRAIN_TOXIC + TRAIN_CLEAN labelled documents, different texts only, by the hash of doc_id. Rows with a null label, id or text aren't used."""
    spark = docs.sparkSession
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for value, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        part = label.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    assert TRAIN_TOXIC + TRAIN_CLEAN <= BROADCAST_ROWS  # so the sample can be broadcast
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = text.join(F.broadcast(picked), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")).toArrow()
    rows = rows.sort_by("doc_id")
    return fit(lower_text(rows["text"]), rows["toxic"].to_numpy())


def flagged(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity, sentences) of the documents at or above the threshold.

    ``sentences`` lists those with a score of at least one half (if none has,
    the highest one): number among the document's sentences that have a word,
    first and last character (the end isn't in it), score. Null and empty texts
    score 0; a null doc_id is reported as null; repeated rows are scored each.
    Other columns aren't read.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        kinds = pa.schema([("doc_id", pa.int64()), ("toxicity", pa.float64()), ("sentences", pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("prob", pa.float64())])))])
        for b in it:
            ids, out = b.column(0).to_pylist(), []
            for lo, _, buf, off in tv.slices(lower_text(b.column(1))):
                for k in np.flatnonzero(document_scores(buf, off, model, table) >= model.threshold).tolist():
                    one, at = buf[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]])
                    score = float(document_scores(one, at, model, table)[0])
                    out.append({"doc_id": ids[lo + k], "toxicity": score, "sentences": located(one, model, table)})
            yield pa.RecordBatch.from_pylist(out, kinds)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, toxicity double, sentences {SENTENCES}")


def located(buf: np.ndarray, model: Model, table: tv.TermTable) -> list[dict]:
    """The offending sentences of one lower-cased text."""
    off = np.array([0, len(buf)])
    starts, _ = tv.word_spans(buf, off)
    sent = np.cumsum(_END[buf])[starts]
    _, s, p = _sentence_scores(buf, off, model, table)
    if not len(s):
        return []
    take = np.flatnonzero(p >= 0.5)
    if not len(take):
        take = np.array([int(np.argmax(p))])
    number = np.searchsorted(np.unique(sent), s)
    ends = np.flatnonzero(_END[buf])
    out = []
    chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))  # characters before each byte
    for k in take.tolist():
        lo = int(starts[np.searchsorted(sent, s[k])])
        stop = np.searchsorted(ends, lo)
        hi = int(ends[stop]) + 1 if stop < len(ends) else len(buf)
        out.append({"sentence": int(number[k]), "start": int(chars[lo]), "end": int(chars[hi]), "prob": float(p[k])})
    return out


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score at or above the threshold; columns unchanged, null texts stay."""
    spark = docs.sparkSession
    prepare(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for b in it:
            keep = np.ones(b.num_rows, bool)
            for lo, hi, buf, off in tv.slices(lower_text(b.column(at))):
                keep[lo:hi] = document_scores(buf, off, model, table) < model.threshold
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
