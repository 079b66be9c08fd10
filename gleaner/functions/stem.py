"""Porter's stemmer (1980) and its Arrow form for token arrays."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Endings and what takes their place.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _closed(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    for ending in sorted(table, key=len, reverse=True):
        if word.endswith(ending):
            stem = word[: -len(ending)]
            return stem + table[ending] if _measure(stem) else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    first_y = word[0] == "y"
    if first_y:
        word = "Y" + word[1:]
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending) and "v" in _shape(word[: -len(ending)]):
                word = word[: -len(ending)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _closed(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for ending in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(ending):
            base = word[: -len(ending)]
            if _measure(base) > 1 and (ending != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _closed(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return "y" + word[1:] if first_y else word


def _stem_arrays(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda words: None if words is None else [stem(w) for w in words])


def stemmed(words: Column) -> Column:
    """Stems of an array of tokens: batches of arrays through Arrow, no shuffle."""
    from ..session import ship

    ship(SparkSession.active())
    return F.pandas_udf(_stem_arrays, "array<string>")(words)
