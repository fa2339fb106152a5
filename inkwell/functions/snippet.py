"""Keyword-in-context snippets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import byte_offsets, is_space, normalize_with_offsets
from inkwell.sources.store import prepare_active

MAX_RESULTS, MAX_KEYWORDS, MAX_TAGS = 16, 32, 512
_ESCAPES = {"<": "&lt;", ">": "&gt;", "&": "&amp;", '"': "&quot;"}


@dataclass(frozen=True)
class Keyword:
    text: str
    open: str
    close: str


class Snippets:
    """Cuts snippets of at most ``width`` bytes around keywords.

    A snippet starts at the earliest hit and takes later hits within the width;
    then it is centred on what it covers. While no more snippets are left than
    keywords that haven't been found, further hits of found ones don't start
    one. A hit that crosses the end isn't tagged.
    """

    def __init__(self, keywords: list[Keyword], width: int, max_results: int, normalize: bool = True, skip_leading_spaces: bool = False, escape: bool = False):
        if not 1 <= max_results <= MAX_RESULTS:
            raise ValueError(f"max_results is 1 to {MAX_RESULTS}")
        if len(keywords) > MAX_KEYWORDS:
            raise ValueError(f"at most {MAX_KEYWORDS} keywords")
        self.width, self.max_results, self.raw, self.skip, self.escape = width, max_results, not normalize, skip_leading_spaces, escape
        self.keywords = []
        for k in keywords:
            if len(k.text.encode()) > width or not k.text:
                raise ValueError(f"keyword {k.text!r} doesn't fit into {width} bytes")
            self.keywords.append(("".join(normalize_with_offsets(k.text, True, self.raw)[0]), k))

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        chars, starts, ends, _ = normalize_with_offsets(text, True, self.raw)
        flat = "".join(chars)
        at = byte_offsets(text)
        total = at[-1]

        def hits(word: str):
            p = flat.find(word) if word else -1
            while p >= 0:
                s = starts[p]
                while self.skip and s < ends[p] - 1 and is_space(text[s]):
                    s += 1
                yield at[s], at[ends[p + len(word) - 1]]
                p = flat.find(word, p + 1)

        walks = [hits(w) for w, _ in self.keywords]
        now = [next(w, None) for w in walks]
        count, parked = [0] * len(now), [False] * len(now)
        unfound, last_end, results, tags_used = len(now), 0, [], 0
        previous = 0
        while len(results) < self.max_results and tags_used < MAX_TAGS:
            tags: list[tuple[int, int, int]] = []
            begin = None
            while True:
                k = min((i for i in range(len(now)) if now[i] and not parked[i]), key=lambda i: (now[i][0], -now[i][1], i), default=None)
                if k is None:
                    break
                s, e = now[k]
                if not tags:
                    if self.max_results - len(results) <= unfound and count[k]:
                        near = any(i != k and now[i] and now[i][1] <= s + self.width and not count[i] for i in range(len(now)))
                        if not near:
                            now[k] = next(walks[k], None)
                            continue
                    begin = s
                else:
                    if s >= begin + self.width:
                        break
                    if s < tags[-1][1]:
                        now[k] = next(walks[k], None)
                        continue
                if e > begin + self.width:
                    parked[k] = True
                    now[k] = next(walks[k], None)
                else:
                    unfound -= not count[k]
                    count[k] += 1
                    last_end = e
                    tags.append((s, e, k))
                    tags_used += 1
                    now[k] = next(walks[k], None)
                    if tags_used >= MAX_TAGS:
                        break
            if not tags:
                break
            if begin + last_end < self.width:
                lo = 0
            else:
                lo = max(min((begin + last_end - self.width) // 2, total - self.width), previous)
            lo = at[bisect_left(at, max(lo, 0))]
            hi = lo + self.width
            hi = at[bisect_right(at, hi) - 1] if hi < total else total
            previous = hi
            results.append(self._tagged(text, at, lo, hi, tags))
            parked = [False] * len(now)
            if not any(now):
                break
        return results

    def _tagged(self, text: str, at: list[int], lo: int, hi: int, tags: list[tuple[int, int, int]]) -> str:
        opens: dict[int, str] = {}
        closes: dict[int, str] = {}
        for s, e, k in tags:
            if s >= lo and e <= hi:
                opens[s] = opens.get(s, "") + self.keywords[k][1].open
            if e <= hi:
                closes[e] = self.keywords[k][1].close + closes.get(e, "")
        out = []
        first, end = bisect_left(at, lo), bisect_left(at, hi)
        for ch, a, b in zip(text[first:end], at[first:end], at[first + 1 : end + 1]):
            out += (opens.get(a, ""), _ESCAPES.get(ch, ch) if self.escape else ch, closes.get(b, ""))
        return "".join(out)


def snippet(c: Column, keywords: list[tuple[str, str, str]], width: int = 100, max_results: int = 3, normalize: bool = True, skip_leading_spaces: bool = False, escape: bool = False, whole_if_none: bool = False) -> Column:
    """Snippets of a text column, an array; ``whole_if_none``: the first ``width`` characters of a text without a hit."""
    prepare_active()
    cut = Snippets([Keyword(*k) for k in keywords], width, max_results, normalize, skip_leading_spaces, escape)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            got = cut(x)
            return got if got or not whole_if_none or not x else [x[:width]]

        return s.map(lambda x: one(x) if isinstance(x, str) else None)

    return run(c)
