"""Text as the indexes hold it: normalisation, diacritic folding, word and trigram tokens."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name of these rules; an index built by others is stale.
VERSION = "words-2"
#: Combining marks that are dropped; every other mark separates words.
MARKS = ((0x300, 0x304), (0x306, 0x30C), (0x30F, 0x30F), (0x311, 0x311), (0x31B, 0x31B), (0x323, 0x328), (0x32D, 0x32E), (0x330, 0x331))
UNIGRAM = ("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "HIRAGANA LETTER", "KATAKANA LETTER", "HALFWIDTH KATAKANA LETTER", "IDEOGRAPHIC NUMBER", "HANGZHOU NUMERAL", "IDEOGRAPHIC ITERATION MARK", "KATAKANA-HIRAGANA PROLONGED")
WORD = r"[\p{L}\p{N}\p{Co}]+"


class _Clean(dict):
    """What each code point becomes, worked out once: spaces of all kinds and controls a space; format characters and variation selectors nothing."""

    def __missing__(self, n: int) -> str:
        c = chr(n)
        kind = unicodedata.category(c)
        if c == "​" or kind in ("Cc", "Zs", "Zl", "Zp"):
            self[n] = " "
        elif kind == "Cf" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
            self[n] = ""
        else:
            self[n] = "�" if kind == "Cs" else c
        return self[n]


_CLEAN = _Clean()
_CHEROKEE = {n: n + 0xAB70 - 0x13A0 for n in range(0x13A0, 0x13F0)} | {n: n + 8 for n in range(0x13F0, 0x13F6)}


def _clean(text: str) -> str:
    return text.translate(_CLEAN)


def is_unigram(c: str) -> bool:
    """Whether a letter is a word of its own: Han, Hiragana, Katakana."""
    return c >= "々" and unicodedata.category(c)[0] in "LN" and unicodedata.name(c, "").startswith(UNIGRAM)


def normalise(text: str | None) -> str:
    """Compatibility forms, case folded, controls and format characters out, East Asian letters apart; null is empty.

    The Turkish dotless i counts as i, dots above an i go, and Cherokee letters take their small forms.
    """
    t = unicodedata.normalize("NFKC", _clean(text or ""))
    t = unicodedata.normalize("NFKC", t.casefold())
    t = re.sub("i̇+", "i", t.replace("ı", "i"))
    t = unicodedata.normalize("NFKC", t.translate(_CHEROKEE) if max(t, default="") >= "\u13a0" else t)
    t = " ".join(_clean(t).split(" ")).strip()
    t = re.sub(" {2,}", " ", t)
    if max(t, default="") < "々":
        return t
    out, before = [], False
    for c in t:
        if is_unigram(c):
            out.append(" " + c if before else c)
            before = True
        else:
            before = before and unicodedata.category(c)[0] == "M"
            out.append(c)
    return "".join(out)


def normalised(text: Column) -> Column:
    """normalise, in batches; ASCII text, most of it, takes a short way to the same result."""

    def run(texts: pd.Series) -> pd.Series:
        spaces = re.compile(r"[\x00-\x20\x7f]+")
        return texts.map(lambda t: spaces.sub(" ", t).strip(" ").lower() if isinstance(t, str) and t.isascii() else normalise(t if isinstance(t, str) else None))

    return F.pandas_udf(run, "string")(text)


@cache
def _table() -> tuple[str, str]:
    """Precomposed small letters of the Latin blocks whose base is an ASCII letter and whose marks are all dropped, and the bases."""
    stripped = {chr(c) for lo, hi in MARKS for c in range(lo, hi + 1)}
    found = {}
    for n in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(n))
        if marks and base.isascii() and base.islower() and set(marks) <= stripped:
            found[chr(n)] = base
    return "".join(found), "".join(found.values())


def _marks() -> str:
    return "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in MARKS) + "]"


def folded(text: Column) -> Column:
    """Lower case without diacritics, in generated code; null is empty."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_table())
    return F.when(plain.rlike(_marks()), F.regexp_replace(plain, _marks(), "")).otherwise(plain)


def fold(text: str) -> str:
    """folded, for one string."""
    t = text.lower().translate(str.maketrans(*_table()))
    return "".join(c for c in t if not any(lo <= ord(c) <= hi for lo, hi in MARKS))


@cache
def _folded_char(c: str) -> str:
    """What one character becomes; marks become nothing."""
    return "".join(x for x in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c).casefold()) if not unicodedata.combining(x))


def folded_map(text: str) -> list[tuple[str, int]]:
    """The folded characters of a text, each with the position of the original that it comes from."""
    return [(x, i) for i, c in enumerate(text) for x in _folded_char(c)]


def tokens(text: Column) -> Column:
    """The words of a text in order: runs of letters, numbers and private characters."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def words(text: str) -> tuple[str, ...]:
    """tokens, for one string."""
    out, run = [], []
    for c in [*fold(normalise(text)), " "]:
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return tuple(out)


def trigrams(text: Column) -> Column:
    """Every window of three characters of a folded text, in order; shorter texts have none."""

    def of(chars: Column) -> Column:
        cut = F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2)))
        return F.array_compact(cut)  # null at the last two

    chars = F.filter(F.split(folded(text), ""), lambda c: c != "")
    return F.element_at(F.transform(F.array(chars), of), 1)  # bound once
