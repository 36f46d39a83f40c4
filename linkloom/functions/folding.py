"""Folding of accents and scripts to plain letters.

``fold_accents`` is the whole of Unicode's compatibility decomposition without combining marks, on the JVM: plain
ASCII stays as it is, other text goes through ICU, which Spark brings along. ``ascii_fold`` also spells out letters
of other scripts, by tables and by the names of the characters, in an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@lru_cache(maxsize=1)
def combining_class() -> str:
    """A regex of one or more characters with a combining class, as ranges of code points."""
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))]
    first = [c for c, before in zip(marks, [-2, *marks], strict=False) if c != before + 1]
    last = [c for c, after in zip(marks, [*marks[1:], -2], strict=True) if c + 1 != after]
    return "[" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in zip(first, last, strict=True)) + "]+"


def fold_accents(text: Column) -> Column:
    """Text in compatibility decomposition (NFKD) without combining marks; null stays null.

    Spark takes a call by reflection for one that may change: it is computed once, in a projection of its own, and
    filters stay above it. So rows are best filtered before they are normalised, and aggregates read a column of it.
    """
    apart = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(apart, combining_class(), "")).otherwise(text)


def fold_text(text: str) -> str:
    """The same of a Python string."""
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))


#: Letters that don't decompose.
SPELLED = dict(zip("ßẞæÆœŒøØđĐłŁþÞðÐħĦıŋŊĸſ", "ss SS ae AE oe OE o O d D l L th Th d D h H i n N k s".split(), strict=True))
PUNCTUATION = dict(zip("‘’‚“”„–—―…·।€£", "' ' , \" \" , - -- -- ... * | EUR PS".split(), strict=True))


@lru_cache(maxsize=65536)
def spell(char: str) -> str:
    """ASCII for one character: itself, its base letters, a table, or what its Unicode name says."""
    if char.isascii():
        return char
    for known in (SPELLED, PUNCTUATION):
        if char in known:
            return known[char]
    base = fold_text(char)
    if base.isascii() and base != char:
        return base
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    name = unicodedata.name(char, "")
    words = name.split()
    if "LETTER" in words or "SIGN" in words and "VOWEL" in words:
        last = words[-1].lower()
        if "VOWEL" in words:
            return last
        if words[0] in ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA"):
            return last  # the consonant's name ends in its inherent vowel
        short = {"alpha": "a", "beta": "b", "gamma": "g", "delta": "d", "epsilon": "e", "zeta": "z", "eta": "e", "theta": "th", "iota": "i", "kappa": "k", "lamda": "l", "mu": "m", "nu": "n", "xi": "x", "omicron": "o", "pi": "p", "rho": "r", "sigma": "s", "tau": "t", "upsilon": "u", "phi": "ph", "chi": "kh", "psi": "ps", "omega": "o", "ef": "f", "el": "l", "em": "m", "en": "n", "er": "r", "es": "s", "ha": "kh"}
        return short.get(last, last)
    return ""


@lru_cache(maxsize=65536)
def ascii_fold_text(text: str) -> str:
    out = []
    for c in text or "":
        mark = unicodedata.name(c, "")
        if mark.endswith("SIGN VIRAMA") and out and out[-1].endswith("a"):
            out[-1] = out[-1][:-1]
        elif "VOWEL SIGN" in mark and out and out[-1].endswith("a"):
            out[-1] = out[-1][:-1] + mark.split()[-1].lower()
        else:
            out.append(spell(c))
    return "".join(out)


@pandas_udf(StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    return text.fillna("").map(ascii_fold_text)
