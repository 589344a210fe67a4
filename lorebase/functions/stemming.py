"""FTS-01: Porter's suffix stripping for English, as published in 1980."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T

# The published suffix tables, longest first where one ends another.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(w: str) -> str:
    """Each letter as v or c; y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def measure(w: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return len(re.findall("v+c+", shape(w)))


def _short(w: str) -> bool:
    return shape(w).endswith("cvc") and w[-1] not in "wxy"


def _replaced(w: str, table: list[tuple[str, str]], least: int) -> str:
    for end, new in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            return base + new if measure(base) > least else w
    return w


def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            base = w[: len(w) - len(end)]
            if w.endswith(end):
                if "v" in shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif base[-2:-1] == base[-1] and shape(base).endswith("c") and base[-1] not in "lsz":
                        base = base[:-1]
                    elif measure(base) == 1 and _short(base):
                        base += "e"
                    w = base
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP2, 0), STEP3, 0)
    for end in sorted(STEP4, key=lambda x: -len(x)):
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems_udf(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return words.map(lambda ws: None if ws is None else [known.get(w) or known.setdefault(w, stem(w)) for w in ws])
