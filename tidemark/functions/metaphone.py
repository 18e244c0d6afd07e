"""Philips' original Metaphone (1990) as an Arrow-batched function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = "AEIOU"


def metaphone(word: str | None) -> str:
    """The code of the letters A to Z in ``word``; accents are dropped, words are coded one by one."""
    folded = "".join(c for c in unicodedata.normalize("NFD", word or "") if unicodedata.category(c) != "Mn").upper()
    return " ".join(c for c in map(_code, re.findall("[A-Z]+", folded)) if c)


def _code(w: str) -> str:
    w = re.sub(r"([ABD-FH-Z])\1+", r"\1", w)  # repeated letters other than C and G count once
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out = []
    for i, c in enumerate(w):
        before, after, later = w[i - 1] if i else "", w[i + 1 : i + 2], w[i + 2 : i + 3]
        front = after and after in "EIY"
        if c in VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (before == "M" and not after):
                out.append("B")
        elif c == "C":
            if before == "S" and front:
                continue
            if after == "I" and later == "A":
                out.append("X")
            elif front:
                out.append("S")
            elif after == "H":
                out.append("K" if before == "S" else "X")
            elif after != "C" or before:
                out.append("K")
        elif c == "D":
            out.append("J" if after == "G" and later and later in "EIY" else "T")
        elif c == "G":
            if (after == "H" and later and later not in VOWELS) or (after == "N" and (not later or w[i + 1 :] == "NED")) or (before == "D" and front):
                continue
            if after == "H" and not later:
                continue
            out.append("J" if front and before != "G" else "K")
        elif c == "H":
            if after and after in VOWELS and before not in tuple("CSPTG"):
                out.append("H")
        elif c == "K":
            if before != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if after == "H" else "P")
        elif c == "Q":
            out.append("K")
        elif c == "S":
            out.append("X" if after == "H" or (after == "I" and later and later in "OA") else "S")
        elif c == "T":
            if after == "I" and later and later in "OA":
                out.append("X")
            elif after == "H":
                out.append("0")
            elif not (after == "C" and later == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if after and after in VOWELS:
                out.append(c)
        elif c == "X":
            out += ["K", "S"]
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
    return "".join(out)


@F.pandas_udf(T.StringType())
def metaphone_code(words: pd.Series) -> pd.Series:
    return words.map(metaphone)
