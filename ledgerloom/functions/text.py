"""Tokens of texts: plain runs of letters and digits in built-in expressions, stemmed ones by a pandas UDF."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def folded(s: str) -> str:
    """Lower case without diacritics."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(ch))


def _measure(w: str) -> int:
    """Of a stem in consonant/vowel form [C](VC)^m[V]: m."""
    return len(re.findall(r"V+C+", _form(w)))


def _form(w: str) -> str:
    out = ""
    for i, ch in enumerate(w):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "C")
        out += "V" if vowel else "C"
    return out


def _short(w: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y."""
    return _form(w)[-3:] == "CVC" and w[-1] not in "wxy"


# Suffixes of steps 2 to 4 of the published suffix-stripping algorithm, each with what replaces it.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(w: str, suffixes) -> str | None:
    found = [s for s in suffixes if w.endswith(s)]
    return max(found, key=len) if found else None


@lru_cache(maxsize=200_000)
def stemmed(w: str) -> str:
    """The stem of an English word by suffix stripping; words of one or two letters stay."""
    if len(w) < 3 or not w.isascii():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and "V" in _form(w[: -len(s)]):
                w, again = w[: -len(s)], True
                break
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "C" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "V" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, STEP_4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_WORD = re.compile(r"[^\W_]+")


def analysed(text: str) -> list[str]:
    """Stemmed tokens of a text, diacritics removed."""
    return [stemmed(t) for t in _WORD.findall(folded(text))]


_PLAIN = regex.compile(TOKEN)


def plain_tokens(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, as ``tokens``."""
    return _PLAIN.findall(text.lower())


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: analysed(t) if t else [])
