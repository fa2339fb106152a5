"""Tokenizers: text to (term, position)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.compat import DEFAULT, Compat
from inkwell.functions import text as T
from inkwell.sources.store import prepare, prepare_active

SLICE_BYTES = 1 << 18  # text that is cut into tokens at once, at least a row
TOKENS = "array<struct<term:string,pos:int>>"
_RUNS = {T.ALPHA: "split_alpha", T.DIGIT: "split_digit", T.SYMBOL: "split_symbol"}


@dataclass(frozen=True)
class Tokenizer:
    """How an index cuts text: ``delimited`` at white space, or ``ngram`` into runs and pairs of characters.

    The kind ``analyser`` is the place for a morphological analyser: ``analyse``
    gets a text and returns its words.
    """

    kind: str = "delimited"
    normalize: bool = False
    split_alpha: bool = False
    split_digit: bool = False
    split_symbol: bool = False
    analyse: object = None
    compat: Compat = DEFAULT

    def column(self, c: Column) -> Column:
        """Tokens for the index."""
        if self.kind == "delimited" and not self.normalize:
            return delimited(c)
        prepare_active()
        tok = self

        @F.pandas_udf(TOKENS)
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: [{"term": t, "pos": p} for t, p in tok.tokens(x)] if isinstance(x, str) else [])

        return run(c)

    def tokens(self, s: str, query: bool = False) -> list[tuple[str, int]]:
        if self.kind == "ngram":
            return [(t, p) for t, p, _ in ngrams(s, self, query)]
        if self.normalize:
            s = T.normalize(s, glue_controls=self.compat.glue_controls)
        if self.kind == "analyser":
            if self.analyse is None:
                raise ValueError("give an analyser")
            return [(w, i) for i, w in enumerate(self.analyse(s))]
        words, word = [], []
        for ch in s + " ":
            if T.is_space(ch):
                if word:
                    words.append("".join(word))
                word = []
            else:
                word.append(ch)
        return [(w, i) for i, w in enumerate(words)]

    def query_tokens(self, s: str) -> tuple[list[tuple[str, int]], bool]:
        """Tokens of a query, and whether the last one is short and stands for its prefixes."""
        if self.kind == "ngram":
            got = ngrams(s, self, True)
            return [(t, p) for t, p, _ in got], bool(got) and got[-1][2]
        return self.tokens(s, True), False


def delimited(c: Column) -> Column:
    """White-space tokens with their ordinal, a native expression."""
    words = F.filter(F.split(c, T.SPACE + "+"), lambda x: x != "")
    got = F.transform(words, lambda x, i: F.struct(x.alias("term"), i.cast("int").alias("pos")))
    return F.coalesce(got, F.array().cast(TOKENS))


def ngrams(s: str, how: Tokenizer, query: bool) -> list[tuple[str, int, bool]]:
    """(term, position, is a short pair) over the text without blanks.

    Runs of letters, digits or symbols are one token each, and end at a blank.
    Other characters give overlapping pairs. A character before a blank, a run
    or the end stands alone in the index; a query skips it before a blank, and
    ends as soon as a pair reaches the end of the text.
    """
    if how.normalize and not how.compat.glue_controls:
        s = s.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32})
    chars, _, _, blank = T.normalize_with_offsets(s, True, raw=not how.normalize)
    if not how.normalize:
        blank = [False] * len(chars)  # raw text has no classes and no blank marks
    joined = [how.normalize and (k := T.char_type(c)) in _RUNS and not getattr(how, _RUNS[k]) for c in chars]
    out, i, n = [], 0, len(chars)
    while i < n:
        if joined[i]:
            j = i + 1
            while j < n and not blank[j - 1] and T.char_type(chars[j]) == T.char_type(chars[i]):
                j += 1
            out.append(("".join(chars[i:j]), i, False))
            i = j
            continue
        pair = i + 1 < n and not blank[i] and not joined[i + 1]
        if blank[i] and query:
            i += 1
            continue
        out.append(("".join(chars[i : i + 2]) if pair else chars[i], i, not pair))
        if query and pair and i + 2 >= n:
            break
        i += 1
    return out


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Rows from and to, in pieces of a bounded length of text."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, side="right")))
        yield lo, hi
        lo = hi


def token_rows(df: DataFrame, key: str, column: str, tokenizer: Tokenizer) -> DataFrame:
    """(key, term, pos) of every token, in batches of a bounded length of text; a row's tokens are never held for a whole batch of rows."""
    prepare(df.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo, hi in slices(b.column(1)):
                row, term, pos = [], [], []
                for i, text in enumerate(b.column(1)[lo:hi].to_pylist(), lo):
                    if text is not None:
                        got = tokenizer.tokens(text)
                        row.append(np.full(len(got), i))
                        term.extend(t for t, _ in got)
                        pos.extend(p for _, p in got)
                if term:
                    yield pa.record_batch([b.column(0).take(pa.array(np.concatenate(row))), pa.array(term, pa.string()), pa.array(pos, pa.int32())], [key, "term", "pos"])

    rows = df.select(key, F.col(column).cast("string").alias("text_"))
    return rows.mapInArrow(run, rows.select(key, F.lit("").alias("term"), F.lit(0).alias("pos")).schema)


def run_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, term, pos): letter, digit and symbol runs of text in a script without pairs, native; positions count characters without blanks. A row's key names its text."""
    words = F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+|\p{N}+|[\p{P}\p{S}]+)"), F.lit(1))
    at = df.select(key, F.posexplode(words).alias("i_", "term"))
    before = Window.partitionBy(key).orderBy("i_").rowsBetween(Window.unboundedPreceding, -1)
    return at.select(key, "term", F.coalesce(F.sum(F.length("term")).over(before), F.lit(0)).cast("int").alias("pos"))
