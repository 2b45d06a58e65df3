"""Porter's stemmer (1980) with folded diacritics, as an Arrow function over distinct words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWEL = "(?:[aeiou]|(?<=[^aeiou])y)"
_CONSONANT = "(?:[^aeiouy]|(?<![^aeiou])y)"
#: Suffix steps 2, 3 and 4 of the algorithm.
STEP2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate "
    "ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
)
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _pairs(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(p.split(":")) for p in text.split()), key=lambda p: -len(p[0]))


_STEP2, _STEP3, _STEP4 = _pairs(STEP2), _pairs(STEP3), sorted(STEP4.split(), key=len, reverse=True)


def _kinds(word: str) -> str:
    """``v`` or ``c`` for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    return len(word) > 2 and _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of under three letters stay."""
    w = word
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _kinds(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEP2, _STEP3):
        for end, new in steps:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in _STEP4:
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def fold(text: str) -> str:
    """Lower case without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def index_terms(text: str | None) -> list[str]:
    """Stems of a text's words, as the index holds them; ``_`` ends a word."""
    return [stem(w) for w in re.findall(r"[^\W_]+", fold(text or ""))]


def stems(x: Column | str) -> Column:
    """``index_terms`` as a column."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(index_terms)

    return run(F.col(x) if isinstance(x, str) else x)


def snippet(text: str | None, terms: set[str], size: int = 12) -> str:
    """The window of ``size`` words with the most distinct stems of ``terms``, hits in brackets, cuts marked."""
    words = [(m.start(), m.end(), stem(fold(m[0]))) for m in re.finditer(r"[^\W_]+", text or "")]
    if not words:
        return ""
    best = max(range(max(1, len(words) - size + 1)), key=lambda i: (len({w[2] for w in words[i : i + size]} & terms), sum(w[2] in terms for w in words[i : i + size]), -i))
    part, out, at = words[best : best + size], "", words[best][0] if best else 0
    for a, b, s in part:
        out += text[at:a] + (f"[{text[a:b]}]" if s in terms else text[a:b])
        at = b
    last = best + size >= len(words)
    return ("" if best == 0 else " … ") + out + (text[at:] if last else " … ")


def snippets(text: Column, terms: Column) -> Column:
    """``snippet`` as a column; ``terms`` are question terms, stemmed here."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([snippet(t, {s for w in (q if q is not None else ()) for s in index_terms(w)}) for t, q in zip(texts, asked)])

    return run(text, terms)
