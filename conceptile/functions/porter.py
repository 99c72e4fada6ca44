"""The Porter stemmer, as published in 1980, over batches of terms."""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import functions as F

#: fixed values: suffixes of steps 2 to 4 and what they become, longest first where one ends in another
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
_ENDS = {name: re.compile("(?:" + "|".join(sorted(s, key=len, reverse=True)) + r")\Z") for name, s in (("2", STEP2), ("3", STEP3), ("4", STEP4))}


def shape(stem: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", shape(stem)))


def short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _suffix(word: str, name: str) -> tuple[str, str]:
    m = _ENDS[name].search(word)
    return (word[: m.start()], m[0]) if m else (word, "")


@cache
def porter(word: str) -> str:
    w = word
    if len(w) < 3:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + new
            break
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for name, table in (("2", STEP2), ("3", STEP3)):
        stem, end = _suffix(w, name)
        if end and measure(stem) > 0:
            w = stem + table[end]
    stem, end = _suffix(w, "4")
    if end and measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
        w = stem
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def stems(depth: int = 1):
    """A function of a column of terms."""

    @F.pandas_udf("string")
    def run(terms: pd.Series) -> pd.Series:
        for _ in range(depth):
            terms = terms.map(porter, na_action="ignore")
        porter.cache_clear()
        return terms

    return run
