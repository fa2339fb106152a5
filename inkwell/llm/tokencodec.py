"""Token ids in compressed binary blocks: an adaptive context-mixing range coder.

A block holds up to ``BLOCK`` ids of consecutive documents and is coded alone:
the model starts anew and a CRC-32 of the ids guards it. Four predictions are
mixed for each id, from what the block has shown so far:

* order 2: the id that came last after the same two ids, at once up to date,
* order 1: the distribution of all ids that came after the same id,
* order 0: the distribution of all ids,
* the uniform distribution, for what is new.

P = w2*[id = guess] + w1*P1 + w0*P0 + wu/V. The weights belong to a state (how
often in a row the guess was right, how much order 1 has seen) and follow each
prediction's share in what was coded in that state (expectation maximisation).
Distributions and weights are brought up to date at the fixed positions of
``refreshes``, so the encoder works on whole arrays. All arithmetic is in whole
numbers. The mixture drives a byte-wise range coder with 56 bits. The blocks of
a task are coded side by side, and decoded side by side.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import textvec as tv
from inkwell.llm.storage import prepare

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 32768
LANES = 128  # blocks coded side by side
TOTAL_BITS = 28
TOTAL = 1 << TOTAL_BITS
_MIXED = TOTAL - TOTAL // 512  # what the uniform distribution leaves to the others at most
_TOP, _LOW = 56, 48
_STEPS = 1024  # ids of each lane that are laid out at once
_REFRESH = 1024  # ids between refreshes, in the end
_TOGETHER = 4  # blocks of one length that are modelled at once
_SEEN = 6  # classes of how much order 1 has seen
_STATES = 5 * _SEEN
_UNIT = 1 << 10  # a coded id in the weights' counts
SCHEMA = "first_doc_id long, block int, doc_ids array<long>, starts array<int>, lengths array<int>, n_ids int, payload binary, checksum long"


def refreshes(n: int) -> list[int]:
    """Positions at which the model is brought up to date."""
    out, at, step = [0], 64, 64
    while at < n:
        out.append(at)
        step = min(step * 2, _REFRESH)
        at += step
    return out


def _guesses(context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id last seen in the same context or -1, confidence 0-4: 0 none, then 1 + hits in a row up to 3)."""
    n = len(ids)
    order = np.argsort(context, kind="stable")  # 16 bits: a radix sort
    c, x = context[order], ids[order]
    same = np.empty(n, bool)
    same[:1] = False
    same[1:] = c[1:] == c[:-1]
    prev = np.empty(n, np.int32)
    prev[:1] = -1
    prev[1:] = x[:-1]
    miss = ~(same & (prev == x))
    at = np.arange(n, dtype=np.int32)
    run = at - np.maximum.accumulate(np.where(miss, at, 0))
    conf = np.zeros(n, np.int8)
    conf[1:] = np.where(same[1:], 1 + np.minimum(run[:-1], 3), 0)
    guess, confidence = np.empty(n, np.int32), np.empty(n, np.int8)
    guess[order] = np.where(same, prev, -1)
    confidence[order] = conf
    return guess, confidence


def _contexts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = np.zeros(len(ids), np.uint16)
    one[1:] = ids[:-1]
    two = np.zeros(len(ids), np.uint16)
    a = ids.astype(np.uint32)
    two[2:] = ((a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)
    return one, two


def _start() -> np.ndarray:
    """(state, prediction) counts before the first id; a prediction that a state can't have counts nothing."""
    out = np.tile(np.array([2, 2, 4, 1], np.int64) * _UNIT, (_STATES, 1))
    out[:_SEEN, 0] = 0
    out[::_SEEN, 1] = 0
    return out


def _weights(counts: np.ndarray) -> np.ndarray:
    """Shares of TOTAL of order 2, 1 and 0; the rest is the uniform distribution's. counts: (..., 4)."""
    return _MIXED * counts[..., :3] // counts.sum(axis=-1, keepdims=True)


def _class(seen: np.ndarray) -> np.ndarray:
    """0, 1-3, 4-15, 16-63, 64-255, more."""
    return (seen > 0).astype(np.int64) + (seen > 3) + (seen > 15) + (seen > 63) + (seen > 255)


_CLASSES = _class(np.arange(1 << 16)).astype(np.int16)


def _numbers(ids: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray, int]:
    """(number of each id among the different ids in order, how many; number of each pair with the id before it among the different pairs in order, the first and the end of its context's pairs, how many)."""
    n = len(ids)
    one = _contexts(ids)[0]
    by_id = np.argsort(ids, kind="stable")  # 16 bits: a radix sort, here and below
    xs = ids[by_id]
    new = np.ones(n, bool)
    np.not_equal(xs[1:], xs[:-1], out=new[1:])
    name = np.empty(n, np.int32)
    name[by_id] = np.cumsum(new, dtype=np.int32) - 1
    n_ids = int(new.sum())
    order = by_id[np.argsort(one[by_id], kind="stable")]
    cs, xs = one[order], ids[order]
    edge = np.ones(n, bool)
    np.not_equal(cs[1:], cs[:-1], out=edge[1:])
    new = edge.copy()
    new[1:] |= xs[1:] != xs[:-1]
    number = np.cumsum(new, dtype=np.int32) - 1
    n_pairs = int(number[-1]) + 1
    begin = np.flatnonzero(edge)
    runs = np.diff(np.append(begin, n))
    pair, first, last = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, np.int32)
    pair[order] = number
    first[order] = np.repeat(number[begin], runs)
    last[order] = np.repeat(np.append(number[begin[1:]], n_pairs), runs)
    return name, n_ids, pair, first, last, n_pairs


def model(ids: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequency, cumulative frequency) out of TOTAL of each id of one block."""
    freq, cum = models([ids], vocab)
    return freq[0], cum[0]


def models(blocks: list[np.ndarray], vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, cumulative frequencies) out of TOTAL of blocks of one length: a row each; their counts lie one after another."""
    n, many = len(blocks[0]), len(blocks)
    x = np.stack(blocks).astype(float)
    guess, sure, name, pair, first, last = (np.empty((many, n), np.int32) for _ in range(6))
    n_ids, n_pairs, first_id = 0, 0, np.zeros((many, 1), np.int64)
    for k, ids in enumerate(blocks if n else []):
        guess[k], sure[k] = _guesses(_contexts(ids)[1], ids.astype(np.int32))
        a, some_ids, b, c, d, some_pairs = _numbers(ids)
        first_id[k] = n_ids
        name[k], pair[k], first[k], last[k] = a + n_ids, b + n_pairs, c + n_pairs, d + n_pairs
        n_ids, n_pairs = n_ids + some_ids, n_pairs + some_pairs
    # different ids and pairs have numbers in their order, which stand for them: counts are over these
    freq, cum = np.empty((many, n), np.int64), np.empty((many, n), np.int64)
    counts0, counts1 = np.zeros(n_ids), np.zeros(n_pairs)
    upto0, upto1 = np.zeros(n_ids + 1), np.zeros(n_pairs + 1)
    held = np.tile(_start(), (many, 1))
    own = np.arange(many)[:, None] * _STATES
    # whole numbers below 2**53 in double precision: quotients are at most 2**28 and divisors far from
    # filling the other bits, so that rounding down the double gives the exact whole quotient
    cuts = [*refreshes(n), n] if n else []
    for lo, hi in zip(cuts, cuts[1:]):
        np.cumsum(counts0, out=upto0[1:])
        np.cumsum(counts1, out=upto1[1:])
        w = _weights(held).astype(float)
        xx, g, k, p = x[:, lo:hi], guess[:, lo:hi], name[:, lo:hi], pair[:, lo:hi]
        base = upto1[first[:, lo:hi]]
        seen = upto1[last[:, lo:hi]] - base
        state = sure[:, lo:hi] * _SEEN + _CLASSES[seen.astype(np.int32)] + own
        w2, w1, w0 = w[:, 0][state], w[:, 1][state], w[:, 2][state] if lo else np.zeros(state.shape)
        wu = TOTAL - w2 - w1 - w0
        parts = np.empty((4, *state.shape))
        np.multiply(w2, g == xx, out=parts[0])
        some, n0 = np.maximum(seen, 1), float(max(lo, 1))
        start = upto0[first_id]
        low1, low0, lowu = np.floor(w1 * (upto1[p] - base) / some), np.floor(w0 * (upto0[k] - start) / n0), np.floor(wu * xx / vocab)
        parts[1] = np.floor(w1 * (upto1[p + 1] - base) / some) - low1
        parts[2] = np.floor(w0 * (upto0[k + 1] - start) / n0) - low0
        parts[3] = np.floor(wu * (xx + 1) / vocab) - lowu
        f = parts.sum(axis=0)
        freq[:, lo:hi] = f
        cum[:, lo:hi] = low1 + low0 + lowu + w2 * (g < xx)
        _learn(held, state.ravel(), parts.reshape(4, -1), f.ravel())
        counts0 += np.bincount(k.ravel(), minlength=n_ids)
        counts1 += np.bincount(p.ravel(), minlength=n_pairs)
    return freq, cum


def _learn(held: np.ndarray, state: np.ndarray, parts: np.ndarray, freq: np.ndarray) -> None:
    """Adds each prediction's share in the coded ids to the counts of their states."""
    share = np.floor(parts * float(_UNIT) / freq)
    for k in range(4):
        held[:, k] += np.bincount(state, share[k], len(held)).astype(np.int64)


def encode(blocks: list[np.ndarray], vocab: int) -> list[bytes]:
    """Payloads of blocks of ids (uint16)."""
    if not blocks:
        return []
    lanes, steps = len(blocks), max(map(len, blocks))
    freq = np.full((lanes, steps), TOTAL, np.uint32)
    cum = np.zeros((lanes, steps), np.uint32)
    size = np.array([len(b) for b in blocks])
    for n in np.unique(size).tolist():
        same = np.flatnonzero(size == n)
        for lo in range(0, len(same), _TOGETHER):
            k = same[lo : lo + _TOGETHER]
            freq[k, :n], cum[k, :n] = models([blocks[i] for i in k], vocab)
    n_words = steps + 8  # an id takes 28 bits at most
    digits = np.zeros((lanes, n_words), np.int64)
    r = np.full(lanes, (1 << _TOP) - 1, np.int64)
    end = np.zeros(lanes, np.int64)
    real, bits = np.empty(lanes), np.empty(lanes, np.int64)
    for lo in range(0, steps, _STEPS):
        hi = min(lo + _STEPS, steps)
        f = np.ascontiguousarray(freq[:, lo:hi].T).astype(np.int64)
        unit, shift = np.empty_like(f), np.empty_like(f)
        # The range and the output position depend on the frequencies alone: one id of all lanes after another.
        for u, s, x in zip(unit, shift, f):
            np.right_shift(r, TOTAL_BITS, out=u)
            np.multiply(u, x, out=r)
            real[:] = r
            np.right_shift(real.view(np.int64), 52, out=bits)  # 1023 + whole part of log2
            np.subtract(1023 + _TOP - 1, bits, out=bits)
            np.bitwise_and(bits, -8, out=s)  # whole bytes that the range lost
            np.left_shift(r, s, out=r)
        live = np.arange(lo, hi)[:, None] < size
        shift *= live
        at = np.cumsum(shift, axis=0)
        at += end
        start = at - shift
        end = at[-1].copy()
        # 56 bits at a byte offset of 0 to 3 in words of 32 bits touch three words
        add = unit.view(np.uint64) * np.ascontiguousarray(cum[:, lo:hi].T)
        by = (start & 31).view(np.uint64)
        base = int((start >> 5).min())
        wide = int((start >> 5).max()) + 3 - base
        where = (start >> 5) - base + np.arange(lanes) * wide
        pick = np.ravel if size.min() >= hi else lambda x: x[live]
        where, add, by = pick(where), pick(add), pick(by)
        left = np.uint64(24) + by
        rest = (add & ((np.uint64(1) << left) - np.uint64(1))) << np.uint64(8)
        second = rest >> by
        third = (rest & ((np.uint64(1) << by) - np.uint64(1))) << (np.uint64(32) - by)
        for k, v in enumerate((add >> left, second, third)):
            got = np.bincount(where + k, v.astype(np.float64), lanes * wide)
            digits[:, base : base + wide] += got.astype(np.int64).reshape(lanes, wide)
    n_words = int(end.max()) // 32 + 3
    d = np.ascontiguousarray(digits[:, :n_words].T)
    for k in range(n_words - 1, 0, -1):  # carries
        d[k - 1] += d[k] >> 32
        d[k] &= 0xFFFFFFFF
    raw = np.ascontiguousarray(d.T).astype(">u4").view(np.uint8).reshape(lanes, -1)
    return [raw[k, : int(end[k]) // 8 + 7].tobytes() if size[k] else b"" for k in range(lanes)]


def decode(payload: bytes, n: int, vocab: int) -> np.ndarray:
    """Ids of one block."""
    return decode_all([payload], [n], vocab)[0]


def decode_all(payloads: list[bytes], sizes: list[int], vocab: int) -> list[np.ndarray]:
    """Ids of blocks, all blocks one id after another; the encoder's model, kept by block."""
    lanes, steps = len(payloads), max(sizes, default=0)
    if not steps:
        return [np.zeros(0, np.uint16) for _ in payloads]
    size = np.array(sizes)
    wide = max(map(len, payloads)) + 32
    data = np.zeros((lanes, wide), np.uint8)
    for k, raw in enumerate(payloads):
        data[k, : len(raw)] = np.frombuffer(raw, np.uint8)
    flat = data.ravel()
    row = np.arange(lanes)
    code = np.zeros(lanes, np.int64)
    for k in range(7):
        code = code << 8 | data[:, k]
    pos = row * wide + 7
    r = np.full(lanes, (1 << _TOP) - 1, np.int64)
    ids = np.zeros((lanes, steps), np.int64)
    upto0 = np.zeros((lanes, vocab + 1), np.int32)
    begins = np.zeros((lanes, vocab + 2), np.int32)  # first pair of each context, from the lane's first
    last2, run2 = np.full((lanes, 65536), -1, np.int32), np.zeros((lanes, 65536), np.int8)
    keys = [np.empty(0, np.int64) for _ in payloads]  # sorted pairs
    many = [np.empty(0, np.int64) for _ in payloads]
    held = np.tile(_start(), (lanes, 1, 1))
    zero = np.zeros(lanes, np.int64)
    one, two = zero, zero
    cuts = [*refreshes(steps), steps]
    for lo, hi in zip(cuts, cuts[1:]):
        live = np.flatnonzero(size > lo)
        if lo:
            for k in live.tolist():
                new = ids[k, before:lo]
                upto0[k, 1:] += np.cumsum(np.bincount(new, minlength=vocab)).astype(np.int32)
                prev = np.concatenate((ids[k, before - 1 : before] if before else [0], new[:-1]))
                pairs, c = np.unique(prev * vocab + new, return_counts=True)
                at = np.searchsorted(keys[k], pairs)
                there = keys[k][np.minimum(at, max(len(keys[k]) - 1, 0))] == pairs if len(keys[k]) else np.zeros(len(pairs), bool)
                many[k][at[there]] += c[there]
                keys[k], many[k] = np.insert(keys[k], at[~there], pairs[~there]), np.insert(many[k], at[~there], c[~there])
                begins[k, 1 : vocab + 1] = np.cumsum(np.bincount(keys[k] // vocab, minlength=vocab))
        before = lo
        offset = np.cumsum([0, *map(len, keys)])
        pair_x = np.concatenate((*[x % vocab for x in keys], [0]))
        upto1 = np.concatenate(([0], np.cumsum(np.concatenate(many))))
        w = _weights(held)
        log = np.zeros((hi - lo, 5, lanes), np.int64)
        flat0 = upto0.ravel()
        base0 = row * (vocab + 1)
        for t in range(lo, hi):
            guess = last2[row, two]
            sure = np.where(guess >= 0, 1 + np.minimum(run2[row, two], 3), 0)
            first, end = offset[:-1] + begins[row, one], offset[:-1] + begins[row, one + 1]
            base = upto1[first]
            seen = upto1[end] - base
            state = sure * _SEEN + _class(seen)
            mine = w[row, state]
            w2, w1, w0 = mine[:, 0], mine[:, 1], mine[:, 2] if lo else zero
            wu = TOTAL - w2 - w1 - w0
            some, n0 = np.maximum(seen, 1), max(lo, 1)
            unit = r >> TOTAL_BITS
            goal = np.minimum(code // unit, TOTAL - 1)

            def below(x: np.ndarray) -> np.ndarray:
                """Of the interval that begins at id x, all but order 1's part."""
                return w0 * flat0[base0 + x] // n0 + wu * x // vocab + w2 * (guess < x)

            # the last of the context's ids that begins at or before the goal
            a, z = first - 1, end.copy()
            for _ in range(int((end - first).max()).bit_length()):
                mid = (a + z) >> 1
                go = mid > a
                m = np.clip(mid, 0, len(upto1) - 1)
                ok = go & (below(pair_x[m]) + w1 * (upto1[m] - base) // some <= goal)
                a, z = np.where(ok, mid, a), np.where(go & ~ok, mid, z)
            has = a >= first
            m = np.clip(a, 0, len(upto1) - 1)
            # that id itself, or one between it and the next of the context's ids
            xa = np.where(has, pair_x[m], -1)
            past = w1 * (np.where(has, upto1[np.minimum(m + 1, len(upto1) - 1)], base) - base) // some
            begin = np.where(has, below(np.maximum(xa, 0)) + w1 * (upto1[m] - base) // some, -1)
            lo_x, hi_x = xa + 1, np.where(a + 1 < end, pair_x[np.minimum(a + 1, len(pair_x) - 1)], vocab)
            inside = has & ((lo_x >= hi_x) | (goal < below(np.minimum(lo_x, vocab)) + past))
            p, q = lo_x, hi_x
            for _ in range(int((q - p)[~inside].max(initial=0)).bit_length()):
                mid = (p + q) >> 1
                go = q - p > 1
                ok = go & (below(mid) + past <= goal)
                p, q = np.where(ok, mid, p), np.where(go & ~ok, mid, q)
            x = np.where(inside, xa, np.minimum(p, vocab - 1))
            low1 = np.where(inside, w1 * (upto1[m] - base) // some, past)
            parts = log[t - lo, :4]
            parts[0] = w2 * (guess == x)
            parts[1] = np.where(inside, past - low1, 0)
            parts[2] = w0 * flat0[base0 + x + 1] // n0 - w0 * flat0[base0 + x] // n0
            parts[3] = wu * (x + 1) // vocab - wu * x // vocab
            log[t - lo, 4] = state
            at, f = below(x) + low1, parts.sum(axis=0)
            code -= unit * at
            r = unit * f
            while (short := r < 1 << _LOW).any():
                r = np.where(short, r << 8, r)
                code = np.where(short, code << 8 | flat[np.minimum(pos, len(flat) - 1)], code)
                pos += short
            ids[:, t] = x
            run2[row, two] = np.where(guess == x, np.minimum(run2[row, two] + 1, 4), 0)
            last2[row, two] = x
            two = ((one * 0x9E3779B1 + x * 0x85EBCA6B) & 0xFFFFFFFF) >> 16 if t else zero
            one = x
        for k in live.tolist():
            n = min(hi, int(size[k])) - lo
            _learn(held[k], log[:n, 4, k], np.ascontiguousarray(log[:n, :4, k].T), log[:n, :4, k].sum(axis=1))
    return [ids[k, : size[k]].astype(np.uint16) for k in range(lanes)]


class Tokenizer:
    """Ids of a public byte-pair vocabulary, each different piece of text encoded once while it is remembered, by a 64-bit hash."""

    MOST = 1 << 21  # twice the pieces kept in memory

    def __init__(self, path: str = VOCABULARY):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.size = len(ranks)
        self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        (self.line_end,) = self.encode("\n")
        self._clear()

    def _clear(self) -> None:
        self.names = np.zeros(2 * self.MOST, np.uint64)  # open addressing; 0 is free
        self.at, self.n = np.zeros(2 * self.MOST, np.int32), np.zeros(2 * self.MOST, np.int32)
        self.flat, self.used, self.held = np.empty(1 << 20, np.uint16), 0, 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each name, or -1."""
        mask = np.uint64(len(self.names) - 1)
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(todo):
            got = self.names[slot]
            hit = got == h[todo]
            out[todo[hit]] = slot[hit]
            more = ~hit & (got != 0)
            todo, slot = todo[more], (slot[more] + 1) & int(mask)
        return out

    def _learn(self, h: np.ndarray, buf: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes and remembers pieces with new names.

        Pieces without white space, but for one space before them, go in one
        call with line ends between them: the pattern never matches across a
        line end beside a visible character, and gives it an id of its own.
        """
        odd = (buf <= 32) | (buf == 0xC2) | (buf >= 0xE0)  # bytes of white space, among others
        upto = np.concatenate(([0], np.cumsum(odd)))
        plain = (upto[ends] == upto[starts + 1]) & ((buf[starts] == 32) & (ends - starts > 1) | ~odd[starts])
        at = np.flatnonzero(plain)
        if len(at):
            text = b"\n".join([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            ids = np.array(self.encode(text.decode("utf-8", "replace")), np.uint16)
            cut = np.flatnonzero(ids == self.line_end)
            if len(cut) == len(at) - 1:
                self._keep(h[at], np.diff(np.concatenate(([-1], cut, [len(ids)]))) - 1, np.delete(ids, cut))
            else:
                plain[:] = False
        at = np.flatnonzero(~plain)
        if len(at):
            got = [self.encode(raw[s:e].decode("utf-8", "replace")) for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            self._keep(h[at], lens, np.fromiter(chain.from_iterable(got), np.uint16, int(lens.sum())))

    def _keep(self, h: np.ndarray, lens: np.ndarray, new: np.ndarray) -> None:
        """Remembers different new names and their ids, one after another."""
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(lens) - lens
        self.used += len(new)
        self.held += len(h)
        mask = len(self.names) - 1
        todo, slot = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.names[slot] == 0
            self.names[slot[free]] = h[todo[free]]  # of several, the last gets it
            won = free & (self.names[slot] == h[todo])
            self.at[slot[won]], self.n[slot[won]] = at[todo[won]], lens[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & mask

    def cuts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where a piece of text begins: at rows, before a single space or line end between two
        visible characters, and after such a line end. The pattern never matches across these."""
        n = len(buf)
        plain = ((buf > 32) & (buf < 127)) | ((buf >= 0xC3) & (buf < 0xE0)) | (buf >= 0xE4)  # begins a character that isn't white space
        before = np.zeros(n, bool)
        before[1:] = (buf[:-1] > 32) & (buf[:-1] < 127)
        before[2:] |= (buf[1:-1] >= 0x80) & (buf[1:-1] < 0xC0) & (buf[:-2] >= 0xC3) & (buf[:-2] < 0xE0)
        after = np.zeros(n, bool)
        after[:-1] = plain[1:]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        alone = before & after & ~edge[:n] & ~edge[1:]
        space, line = alone & (buf == 32), alone & (buf == 10)
        begin = edge[:n] | space | line
        begin[1:] |= line[:-1]
        return np.flatnonzero(begin)

    def rows(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, first id of each row and the end)."""
        starts = self.cuts(buf, off)
        ends = np.append(starts[1:], len(buf))
        if not len(starts):
            return np.empty(0, np.uint16), np.zeros(len(off), np.int64)
        h = tv.span_hash(tv.prefix_hash(buf), starts, ends)
        h[h == 0] = 1
        if self.held > self.MOST // 2:
            self._clear()
        raw, slot = buf.tobytes(), self._find(h)
        lost = np.flatnonzero(slot < 0)
        if len(lost):
            some, first = np.unique(h[lost], return_index=True)
            if len(some) > self.MOST // 2:  # so many different ones in one slice: without the memory
                return self._plain(raw, starts, ends, off)
            part = lost[first]
            self._learn(some, buf, raw, starts[part], ends[part])
            slot[lost] = self._find(h[lost])
        n = self.n[slot].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(n)))
        return self.flat[tv.ragged(self.at[slot].astype(np.int64), n)], upto[np.searchsorted(starts, off)]

    def _plain(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(self.encode(raw[s:e].decode("utf-8", "replace")), np.uint16) for s, e in zip(starts.tolist(), ends.tolist())]
        upto = np.concatenate(([0], np.cumsum([len(x) for x in got])))
        return np.concatenate(got), upto[np.searchsorted(starts, off)]


_tokenizers: dict[str, Tokenizer] = {}


def shipped(spark: SparkSession, path: str) -> str:
    """Sends a file to all workers; they find it by the name that is returned."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def write_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """One row per block: the documents in it with the first id and number of ids of each piece, and the coded ids.

    Texts are tokenised whole. Blocks are filled in the order of the rows; a
    document that doesn't fit goes on in the next block. ``block`` numbers the
    blocks that begin with one document, so (first_doc_id, block) names a block
    where ids are unique. Null and empty texts have no ids and are in no block;
    a null doc_id is kept as null; repeated rows are written each. Other
    columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    file = shipped(spark, vocabulary)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(SparkFiles.get(file))
        ready: list[tuple[list, np.ndarray]] = []
        open_: list[tuple] = []  # (doc, start, ids)
        used = 0

        def close() -> None:
            ready.append(([(d, s, len(x)) for d, s, x in open_], np.concatenate([x for _, _, x in open_])))
            open_.clear()

        def flush() -> pa.RecordBatch:
            coded = encode([ids for _, ids in ready], tok.size)
            out = pa.record_batch(
                [
                    pa.array([p[0][0] for p, _ in ready], pa.int64()),
                    pa.array([p[0][1] // block for p, _ in ready], pa.int32()),
                    pa.array([[d for d, _, _ in p] for p, _ in ready], pa.list_(pa.int64())),
                    pa.array([[s for _, s, _ in p] for p, _ in ready], pa.list_(pa.int32())),
                    pa.array([[n for _, _, n in p] for p, _ in ready], pa.list_(pa.int32())),
                    pa.array([len(ids) for _, ids in ready], pa.int32()),
                    pa.array(coded, pa.binary()),
                    pa.array([zlib.crc32(ids.tobytes()) for _, ids in ready], pa.int64()),
                ],
                ["first_doc_id", "block", "doc_ids", "starts", "lengths", "n_ids", "payload", "checksum"],
            )
            ready.clear()
            return out

        for b in it:
            names = b.column(0).to_pylist()
            for lo, hi, buf, off in tv.slices(b.column(1), 4 * tv.SLICE_BYTES):
                ids, first = tok.rows(buf, off)
                for k in range(hi - lo):
                    at, end = int(first[k]), int(first[k + 1])
                    begin = at
                    while at < end:
                        n = min(end - at, block - used)
                        open_.append((names[lo + k], at - begin, ids[at : at + n]))
                        used += n
                        at += n
                        if used == block:
                            close()
                            used = 0
                            if len(ready) == LANES:
                                yield flush()
        if open_:
            close()
        if ready:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def read_blocks(blocks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, ids) of every piece of a document.

    A block whose checksum fails, as after damage to its payload, or that lacks
    its payload or number of ids, raises an error that names it. No blocks: no rows.
    """
    prepare(blocks.sparkSession)
    file = shipped(blocks.sparkSession, vocabulary)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = tokenizer(SparkFiles.get(file)).size
        for b in it:
            for lo in range(0, b.num_rows, LANES):
                rows = b.slice(lo, LANES).to_pylist()
                for row in rows:
                    if row["payload"] is None or row["n_ids"] is None or sum(row["lengths"]) != row["n_ids"]:
                        raise ValueError(f"block {row['first_doc_id']}/{row['block']}: a part is missing")
                for row, ids in zip(rows, decode_all([x["payload"] for x in rows], [x["n_ids"] for x in rows], size)):
                    if zlib.crc32(ids.tobytes()) != row["checksum"]:
                        raise ValueError(f"block {row['first_doc_id']}/{row['block']}: the checksum is wrong")
                    cut = np.cumsum(row["lengths"])[:-1]
                    yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(row["starts"], pa.int32()), pa.array([x.tolist() for x in np.split(ids, cut)], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start int, ids array<int>")
