"""English stems by Porter's published algorithm of 1980, for words of a-z; others stay as they are."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import words

#: Endings and what they become, of the algorithm's second and third steps, and those that its fourth drops.
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _pattern(word: str) -> str:
    """Each letter as c (consonant) or v (vowel)."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return len(re.findall("v+c", _pattern(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _pattern(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swapped(word: str, endings: dict[str, str], least: int) -> str:
    end = max((e for e in endings if word.endswith(e)), key=len, default=None)
    return word[: -len(end)] + endings[end] if end and _measure(word[: -len(end)]) > least else word


@lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    # Plurals and past forms.
    if word.endswith("s") and not word.endswith("ss"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        base = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in _pattern(word[: -len(e)])), None)
        if base is not None:
            twice = len(base) > 1 and base[-1] == base[-2] and _pattern(base)[-1] == "c" and base[-1] not in "lsz"
            word = base + "e" if base.endswith(("at", "bl", "iz")) else base[:-1] if twice else base + "e" if _measure(base) == 1 and _short(base) else base
    if word.endswith("y") and "v" in _pattern(word[:-1]):
        word = word[:-1] + "i"
    # Longer endings.
    word = _swapped(_swapped(word, SECOND, 0), THIRD, 0)
    end = max((e for e in FOURTH if word.endswith(e)), key=len, default=None)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(lists: pd.Series) -> pd.Series:
    return lists.map(lambda found: None if found is None else [stem(w) for w in found])


def stemmed_words(x: Column) -> Column:
    """Stems of a text's words, in order: tokens for a search."""
    return _stems(words(x))
