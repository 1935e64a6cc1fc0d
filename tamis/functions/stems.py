"""Porter's stemmer (1980) by tables of endings, as a vectorised column that stems each distinct word of a batch once."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Endings and what they become, by step, the longest match first; steps 2 and 3 need a measure over 0, step 4 one over 1.
SECOND = dict(p.split(":") for p in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
THIRD = dict(p.split(":") for p in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
FOURTH = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
_LETTERS = re.compile("^[a-z]+$")


def _shape(word: str) -> str:
    """c and v for each letter; y after a consonant is a vowel."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out[-1:] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    end = next((e for e in sorted(table, key=len, reverse=True) if word.endswith(e)), None)
    if end is None:
        return word
    stem = word[: len(word) - len(end)]
    return stem + table[end] if _measure(stem) > least else word


def stem(word: str) -> str:
    """The stem of a word of small letters a-z; other words, and those of two letters or fewer, stay."""
    if len(word) <= 2 or not _LETTERS.match(word):
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if end:
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-2:-1] == word[-1:] and _shape(word)[-1:] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, SECOND, 0), THIRD, 0)
    end = next((e for e in sorted([*FOURTH, "ion"], key=len, reverse=True) if word.endswith(e)), None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stems of an array of words, in order; null stays."""
    known: dict[str, str] = {}

    def one(row):
        if row is None:
            return None
        return [known[w] if w in known else known.setdefault(w, stem(w)) for w in row]

    return words.map(one)
