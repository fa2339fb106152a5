"""Vectorised words and hashes over UTF-8 bytes.

Operators hand lower-cased text to Python as Arrow strings; here the bytes are
cut into words and hashed with whole-array numpy arithmetic, so that no Python
object is made for a word.

A *word* is a maximal run of ASCII letters and digits and of characters from
U+0080 on, without U+0080-U+00BF (but the letters U+00AA, U+00B5, U+00BA),
U+00D7, U+00F7, U+2000-U+206F and U+3000-U+303F. ``WORD_RE`` says the same as
a regular expression (RE2 syntax, for DuckDB). A *term* is the 52-bit hash of a
word's bytes, a non-negative int64: 10**8 distinct words collide about once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = (
    r"[a-z0-9\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1FFF}"
    r"\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"
)
TERM_BITS = 52
MAX_ROWS = 1 << 11  # rows of a slice; row number and term share a 64-bit key
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_pow = {"n": 0, "p": np.empty(0, np.uint64), "i": np.empty(0, np.uint64)}

_CLASS = np.zeros(256, np.bool_)
_CLASS[48:58] = _CLASS[97:123] = _CLASS[65:91] = True
_CLASS[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = max(n, SLICE_BYTES + 65536)
        for key, base in (("p", _P), ("i", _PINV)):
            out = np.full(size, np.uint64(base), np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _pow[key] = out
        _pow["n"] = size
    return _pow["p"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums: S[e] - S[s] times P**-s names buf[s:e]."""
    p, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each buf[start:end]; equal bytes, equal hash."""
    _, inv = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts])


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) in bounded pieces; null is empty.

    A single text longer than ``max_bytes`` comes whole in a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + MAX_ROWS, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def _word_mask(buf: np.ndarray) -> np.ndarray:
    ok = _CLASS[buf]
    if not len(buf) or buf.max() < 128:
        return ok
    nxt = np.zeros(len(buf), np.uint8)
    nxt[:-1] = buf[1:]
    at = np.flatnonzero((buf == 0xC2) & (nxt != 0xAA) & (nxt != 0xB5) & (nxt != 0xBA))
    ok[at] = False
    ok[np.minimum(at + 1, len(buf) - 1)] = False
    at = np.flatnonzero((buf == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7)))
    ok[at] = ok[np.minimum(at + 1, len(buf) - 1)] = False
    at = np.flatnonzero(((buf == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | ((buf == 0xE3) & (nxt == 0x80)))
    if len(at):
        third = buf[np.minimum(at + 2, len(buf) - 1)]
        at = at[~((buf[at] == 0xE2) & (nxt[at] == 0x81) & (third >= 0xB0))]
        for k in range(3):
            ok[np.minimum(at + k, len(buf) - 1)] = False
    return ok


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word ends where its row ends."""
    n = len(buf)
    ok = _word_mask(buf)
    begin = ok.copy()
    begin[1:] &= ~ok[:-1]
    edge = off[1:-1]
    edge = edge[edge < n]
    begin[edge] = ok[edge]
    stop = np.zeros(n + 1, np.bool_)
    stop[1:n] = ok[:-1] & ~ok[1:]
    inner = off[(off > 0) & (off <= n)]
    stop[inner] = ok[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term of each word, first word of each row and the end)."""
    starts, ends = word_spans(buf, off)
    terms = (span_hash(prefix_hash(buf), starts, ends) >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    return terms, np.searchsorted(starts, off)


def term_of(word: str) -> int:
    """The term of one word, as ``words`` gives it."""
    buf = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(prefix_hash(buf), np.array([0]), np.array([len(buf)]))[0] >> np.uint64(64 - TERM_BITS))


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def counted(terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) in order, with how often each occurs."""
    key = (rows_of(first).astype(np.uint64) << np.uint64(TERM_BITS)) | terms.astype(np.uint64)
    key.sort()
    if not len(key):
        e = np.empty(0, np.int64)
        return e, e, e
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(TERM_BITS)).astype(np.int64), (key & np.uint64((1 << TERM_BITS) - 1)).astype(np.int64), tf


class TermTable:
    """Vectorised lookup of terms in a fixed set: a position, or -1."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.asarray(terms, np.int64)
        bits = max(10, int(np.ceil(np.log2(max(len(self.terms), 1) * 16))))
        self.shift = np.uint64(TERM_BITS - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int32)
        self.probes = 1
        home = (self.terms.astype(np.uint64) >> self.shift).astype(np.int64)
        for i, h in enumerate(home.tolist()):
            k = 0
            while self.slots[h + k] >= 0:
                k += 1
                if h + k + 1 >= len(self.slots):
                    self.slots = np.concatenate((self.slots, np.full(64, -1, np.int32)))
            self.slots[h + k] = i
            self.probes = max(self.probes, k + 1)

    def find(self, terms: np.ndarray) -> np.ndarray:
        out = np.full(len(terms), -1, np.int32)
        if not len(self.terms) or not len(terms):
            return out
        home = (terms.astype(np.uint64) >> self.shift).astype(np.int64)
        for k in range(self.probes):
            slot = self.slots[home + k]
            hit = np.flatnonzero(slot >= 0)
            hit = hit[self.terms[slot[hit]] == terms[hit]]
            out[hit] = slot[hit]
        return out


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start+1, ... of the given lengths."""
    total = int(lens.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lens > 0
    s, n = starts[keep], lens[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(out)
