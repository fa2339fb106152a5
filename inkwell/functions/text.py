"""Text normalisation and character classes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import accumulate

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from inkwell.sources.store import prepare_active

SPACE = "[ \\f\\n\\r\\t\\x0B\\u3000]"
_SPACES = frozenset(" \f\n\r\t\v　")
NULL, ALPHA, DIGIT, SYMBOL, HIRAGANA, KATAKANA, KANJI, OTHERS = range(8)
CHARSETS = {"utf8": "UTF-8", "euc-jp": "EUC-JP", "sjis": "Windows-31J", "latin1": "windows-1252", "koi8r": "KOI8-R"}


def is_space(ch: str) -> bool:
    return ch in _SPACES


@lru_cache(maxsize=65536)
def char_type(ch: str) -> int:
    """Class of a character: by block for Japanese scripts, else by general category."""
    o = ord(ch)
    if 0x3041 <= o <= 0x309F:
        return HIRAGANA
    if 0x30A0 <= o <= 0x30FF or 0x31F0 <= o <= 0x31FF or 0xFF66 <= o <= 0xFF9F:
        return KATAKANA
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x2FA1F or o == 0x3005:
        return KANJI
    return {"L": ALPHA, "N": DIGIT, "P": SYMBOL, "S": SYMBOL}.get(unicodedata.category(ch)[0], OTHERS)


@lru_cache(maxsize=65536)
def _mapped(ch: str) -> str:
    """Compatibility form in lower case; a space that the decomposition puts in front is dropped."""
    m = unicodedata.normalize("NFKC", ch).lower()
    return m[1:] if len(m) > 1 and m[0] == " " else m


class _Clean(dict):
    """Mapped form of a character without control characters."""

    def __missing__(self, ch: str) -> str:
        self[ch] = got = "".join(c for c in _mapped(ch) if c >= " ")
        return got


#: Categories of which no character joins the one before it.
_APART = frozenset(("Lu", "Ll", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "So"))


class _Apart(dict):
    """Whether a character is mapped to characters that don't join what stands before them."""

    def __missing__(self, ch: str) -> bool:
        self[ch] = got = all(c < "\u0300" or unicodedata.category(c) in _APART for c in _CLEAN[ch])
        return got


class _Map(dict):
    """``_CLEAN`` by code point, for str.translate."""

    def __missing__(self, o: int) -> str:
        self[o] = got = _CLEAN[chr(o)]
        return got


class _Raw(dict):
    def __missing__(self, ch: str) -> str:
        self[ch] = ch
        return ch


_CLEAN, _RAW, _APART_OF, _MAP = _Clean(), _Raw(), _Apart(), _Map()


def mapped_apart(s: str) -> str | None:
    """``s`` normalised with its blanks, where each character can be mapped by itself; else None."""
    return s.translate(_MAP) if all(map(_APART_OF.__getitem__, set(s))) else None


@lru_cache(maxsize=65536)
def _composed(a: str, b: str) -> str | None:
    """a and b as one character, if there is one; half-width voiced kana included."""
    b = {"゛": "゙", "゜": "゚"}.get(b, b)
    c = unicodedata.normalize("NFC", a + b)
    return c if len(c) == 1 else None


def normalize_with_offsets(s: str, remove_blank: bool = False, raw: bool = False) -> tuple[list[str], list[int], list[int], list[bool]]:
    """(characters, start and end in ``s`` of what each stands for, whether a blank or control character follows).

    A start lies right after the end of the character before, so that blanks
    taken out belong to the character that follows them.
    """
    out, starts, ends, blank = [], [], [], []
    last = 0
    table = _RAW if raw else _CLEAN
    for i, ch in enumerate(s):
        got = table[ch]
        if remove_blank and (got == " " or raw and ch in _SPACES):
            got = ""
        if not got:
            if out and (ch < " " or ch in _SPACES):
                blank[-1] = True
            continue
        if raw or len(got) == 1 and got < "\u0300":  # nothing below joins the character before it
            out.append(got)
            starts.append(last)
            ends.append(i + 1)
            blank.append(False)
            last = i + 1
            continue
        for c in got:
            both = None if not out or blank[-1] or c < "\u0300" else _composed(out[-1], c)
            if both:
                out[-1], ends[-1], last = both, i + 1, i + 1
            else:
                out.append(c)
                starts.append(last)
                ends.append(i + 1)
                blank.append(False)
        last = i + 1
    return out, starts, ends, blank


def byte_offsets(s: str) -> list[int] | range:
    """UTF-8 offset of each character, and of the end."""
    if s.isascii():
        return range(len(s) + 1)
    return list(accumulate((1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in s), initial=0))


def normalize(s: str | None, remove_blank: bool = False, glue_controls: bool = True) -> str | None:
    """NFKC in lower case without control characters; unless ``glue_controls``, line ends and tabs become spaces first."""
    if s is None:
        return None
    if not glue_controls:
        s = s.translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32})
    if s.isascii():
        s = "".join(c for c in s.lower() if c >= " ") if not s.isprintable() else s.lower()
        return s.replace(" ", "") if remove_blank else s
    got = mapped_apart(s)
    if got is not None:
        return got.replace(" ", "") if remove_blank else got
    return "".join(normalize_with_offsets(s, remove_blank)[0])


def normalize_text(c: Column, remove_blank: bool = False, glue_controls: bool = True) -> Column:
    """Full normalisation as an Arrow UDF; rows pass one after another, so a batch is held as Arrow only."""
    prepare_active()

    @F.arrow_udf("string")
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array((normalize(x.as_py(), remove_blank, glue_controls) for x in texts), pa.string(), size=len(texts))

    return run(c.cast("string"))


def normalize_ascii(c: Column) -> Column:
    """The same for text in which only ASCII letters need folding, inside the JVM."""
    return F.lower(F.regexp_replace(c, r"[\x00-\x1f]", ""))


def decode(c: Column, charset: str) -> Column:
    """Bytes of another character set to text."""
    return F.decode(c, CHARSETS.get(charset, charset))


def char_length_at(c: Column, i: int) -> Column:
    """Bytes of the i-th character (from 1); 0 past the end."""
    return F.octet_length(F.substring(c, i, 1))
