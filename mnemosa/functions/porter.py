"""Porter stemming of lower-case words, for keyword search with stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffix tables of the published algorithm (Porter 1980), steps 2 to 4.
STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble logi log".split()
STEP3 = ["icate", "ic", "ative", "", "alize", "al", "iciti", "ic", "ical", "ic", "ful", "", "ness", ""]
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _pairs(table: list[str]) -> tuple[tuple[str, ...], list[tuple[str, str]]]:
    """All ends of a table, and its pairs, longest ends first."""
    return tuple(table[::2]), sorted(zip(table[::2], table[1::2], strict=True), key=lambda p: -len(p[0]))


_PAIRED = (_pairs(STEP2), _pairs(STEP3))
_LAST = sorted([*STEP4, "ion"], key=len, reverse=True)
_LAST_ANY = tuple(_LAST)


def _shape(w: str) -> str:
    """c and v for each letter; y after a consonant is a vowel."""
    out, last = [], ""
    for ch in w:
        last = "v" if ch in "aeiou" or (ch == "y" and last == "c") else "c"
        out.append(last)
    return "".join(out)


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _short(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def stem_of(w: str) -> str:
    """The stem of a word."""
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for ends, pairs in _PAIRED:
        if w.endswith(ends):
            end, new = next(p for p in pairs if w.endswith(p[0]))
            if _measure(w[: -len(end)]):
                w = w[: -len(end)] + new
    if w.endswith(_LAST_ANY):
        end = next(e for e in _LAST if w.endswith(e))
        if _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4:-3] in ("s", "t")):
            w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(200_000)
def stem(w: str) -> str:
    """As stem_of, and remembered."""
    return stem_of(w)


def fold(text: str) -> str:
    """Lower case without marks on letters."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def porter(word: Column) -> Column:
    """The stem of a word."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: w if w is None else stem(w))

    return run(word)


def stemmed_words(text: Column) -> Column:
    """Folded and stemmed words of a text."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [stem(w) for w in re.findall(r"[^\W_]+", fold(t or ""))])

    return run(text)
