"""Similarities of pairs: native Column functions where Spark has the parts, Arrow UDFs for the rest.

The fuzzy ratios follow their public definitions: a ratio is 100 times one less the insert-and-delete
distance over both lengths, found by the longest common subsequence. They are computed for all pairs of a batch
in step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from linkloom.functions.text import char_ngrams, words_of


def ratio_or(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return 1 - ratio_or(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)), 0.0)


def length_ratio(a: Column, b: Column) -> Column:
    return ratio_or(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)), 1.0)


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two arrays as sets; ``empty`` if both are."""
    return ratio_or(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), empty)


def containment(a: Column, b: Column) -> Column:
    """Shared words over the smaller set; 0 if either is empty."""
    return ratio_or(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), 0.0)


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Of character n-grams; texts of which one is shorter than n are compared as wholes."""
    short = (F.length(a) < n) | (F.length(b) < n)
    return F.when(short, (a == b).cast("double")).otherwise(jaccard(char_ngrams(a, n), char_ngrams(b, n)))


def numbers_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[0-9]+\b"), F.lit(0)))


def number_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the numbers in two texts; 1 if neither has any."""
    return jaccard(numbers_in(a), numbers_in(b))


def number_matches(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(numbers_in(a), numbers_in(b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller set of words, 0 if either has none."""
    return containment(words_of(a), words_of(b)).cast("float")


def shared_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(words_of(a), words_of(b)))


def number_sets(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Numbers only in b, only in a, and their Jaccard; -1 if b has none."""
    x, y = words_of(a), words_of(b)
    none = F.size(y) == 0
    guard = lambda c: F.when(none, F.lit(-1)).otherwise(c)
    return guard(F.size(F.array_except(y, x))), guard(F.size(F.array_except(x, y))), F.when(none, F.lit(-1.0)).otherwise(jaccard(x, y))


def number_agreement(a: Column, b: Column) -> Column:
    """Of the numbers among the words: -1 none on either side, 2 the same, 1 some shared, 0 otherwise."""
    digits = lambda t: F.array_distinct(F.filter(words_of(t), lambda w: w.rlike("^[0-9]+$")))
    x, y = digits(a), digits(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), -1).when(F.array_sort(x) == F.array_sort(y), 2).when(F.arrays_overlap(x, y), 1).otherwise(0)


def jaccard100(a: Column, b: Column) -> Column:
    """Jaccard of words times 100; -1 if the first has none."""
    return F.when(F.size(words_of(a)) == 0, F.lit(-1.0)).otherwise(100 * jaccard(words_of(a), words_of(b)))


# Definitions behind the Arrow UDFs, over lists of pairs at once.

WORD = 63  # characters of the shorter text that fit into the bits of one row
BATCH = 8192


def _codes(texts: list[str], width: int, fill: int) -> np.ndarray:
    """Code points of texts as rows of one matrix."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.full((len(texts), width), fill, dtype=np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _lcs_block(short: list[str], long: list[str]) -> np.ndarray:
    """Longest common subsequences, all pairs in step: a row of the table of prefixes is the bits of one number."""
    order = np.argsort([-len(x) for x in long], kind="stable")
    long_sizes = np.array([len(long[i]) for i in order])
    sizes = np.array([len(short[i]) for i in order])
    a = _codes([short[i] for i in order], WORD + 1, 0x110000)
    b = _codes([long[i] for i in order], int(long_sizes.max(initial=0)), 0x110001)
    full = (np.uint64(1) << sizes.astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    for t in range(b.shape[1]):
        n = int(np.searchsorted(-long_sizes, -t, "left"))  # pairs whose longer text goes on
        same = np.packbits(a[:n] == b[:n, t, None], axis=1, bitorder="little").view("<u8").ravel()
        hit = row[:n] & same
        row[:n] = ((row[:n] + hit) | (row[:n] - hit)) & full[:n]
    out = np.empty(len(short), dtype=np.int64)
    out[order] = sizes - np.bitwise_count(row).astype(np.int64)
    return out


def _lcs_long(a: str, b: str) -> int:
    """The same of one pair of any length, by bits of one whole number."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True) if a else ((), ())
    out = np.zeros(len(a), dtype=np.int64)
    fits = [i for i, x in enumerate(short) if 0 < len(x) <= WORD]
    for at in range(0, len(fits), BATCH):
        part = fits[at : at + BATCH]
        out[part] = _lcs_block([short[i] for i in part], [long[i] for i in part])
    for i, x in enumerate(short):
        if len(x) > WORD:
            out[i] = _lcs_long(x, long[i])
    return out


Scores = Callable[[list[str], list[str]], np.ndarray]


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    both = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), dtype=np.float64, count=len(a))
    return np.where(both > 0, 200.0 * lcs_lengths(a, b) / np.maximum(both, 1), 100.0)


def _sorted_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    return indel_ratios(list(map(_sorted_words, a)), list(map(_sorted_words, b)))


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Best of: shared words against each side's, and the sides against each other; 0 if a side has no words."""
    out = np.zeros(len(a))
    place, left, right = [], [], []
    for i, (x, y) in enumerate(zip(map(set, map(str.split, a)), map(set, map(str.split, b)), strict=True)):
        shared = x & y
        if not x or not y:
            continue
        if shared and (x <= y or y <= x):
            out[i] = 100.0
            continue
        core = " ".join(sorted(shared))
        one, two = (" ".join([*([core] if core else []), *sorted(rest)]) for rest in (x - y, y - x))
        sides = [(one, two), (core, one), (core, two)] if core else [(one, two)]
        place += [i] * len(sides)
        left += [s[0] for s in sides]
        right += [s[1] for s in sides]
    np.maximum.at(out, np.array(place, dtype=np.int64), indel_ratios(left, right))
    return out


def _windows(short: str, long: str) -> set[str]:
    """Parts of the longer text that the shorter one is held against: all of its length, and shorter ones at the edges."""
    n = len(short)
    return {long[max(start, 0) : start + n] for start in range(1 - n, len(long))}


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Best ratio of the shorter text with a window of the longer; of texts of one length either may be the window."""
    out = np.zeros(len(a))
    place, left, right = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if not x or not y:
            out[i] = 100.0 * (x == y)
            continue
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        if short in long:
            out[i] = 100.0
            continue
        sides = [(short, w) for w in _windows(short, long)] + ([(long, w) for w in _windows(long, short)] if len(x) == len(y) else [])
        place += [i] * len(sides)
        left += [s[0] for s in sides]
        right += [s[1] for s in sides]
    np.maximum.at(out, np.array(place, dtype=np.int64), indel_ratios(left, right))
    return out


def partial_token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    sets = [(set(x.split()), set(y.split())) for x, y in zip(a, b, strict=True)]
    rest = partial_ratios([" ".join(sorted(x - y)) for x, y in sets], [" ".join(sorted(y - x)) for x, y in sets])
    return np.array([0.0 if not x or not y else 100.0 if x & y else r for (x, y), r in zip(sets, rest, strict=True)])


def weighted_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """Whole ratios for texts of like length, partial ones with a lower weight otherwise."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.float64).reshape(-1, 2)
    empty = sizes.min(axis=1) == 0
    longer = sizes.max(axis=1) / np.maximum(sizes.min(axis=1), 1)
    best = indel_ratios(a, b)
    like, far = np.flatnonzero(longer < 1.5), np.flatnonzero((longer >= 1.5) & ~empty)
    pick = lambda texts, at: [texts[i] for i in at]
    x, y = pick(a, like), pick(b, like)
    best[like] = np.maximum(best[like], 0.95 * np.maximum(token_sort_ratios(x, y), token_set_ratios(x, y)))
    x, y = pick(a, far), pick(b, far)
    scale = np.where(longer[far] <= 8, 0.9, 0.6)
    words = np.maximum(partial_ratios(list(map(_sorted_words, x)), list(map(_sorted_words, y))), partial_token_set_ratios(x, y))
    best[far] = np.maximum(best[far], np.maximum(scale * partial_ratios(x, y), 0.95 * scale * words))
    return np.where(empty, 0.0, best)


def jaro_winklers(a: list[str], b: list[str], weight: float = 0.1, most: int = 4) -> np.ndarray:
    """The prefix counts at any similarity; transpositions are halved without rounding."""
    out = np.fromiter((1.0 if x == y else 0.0 for x, y in zip(a, b, strict=True)), dtype=np.float64, count=len(a))
    todo = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and x != y]
    todo.sort(key=lambda i: max(len(a[i]), len(b[i])))  # so that a block's matrices are as wide as its texts
    for at in range(0, len(todo), 1024):
        part = todo[at : at + 1024]
        out[part] = _jaro_winkler_block([a[i] for i in part], [b[i] for i in part], weight, most)
    return out


def _jaro_winkler_block(a: list[str], b: list[str], weight: float, most: int) -> np.ndarray:
    """Letter by letter of the first texts: the first free equal letter of the second within reach is taken."""
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    x, y = _codes(a, int(m.max()), 0x110000), _codes(b, int(n.max()), 0x110001)
    reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
    places, every = np.arange(y.shape[1])[None, :], np.arange(len(a))
    met, taken = np.zeros(x.shape, dtype=bool), np.zeros(y.shape, dtype=bool)
    for i in range(x.shape[1]):
        free = (y == x[:, i, None]) & ~taken & (np.abs(places - i) <= reach[:, None])
        met[:, i] = free.any(axis=1)
        taken[every[met[:, i]], free.argmax(axis=1)[met[:, i]]] = True
    count = met.sum(axis=1)
    # Both sides' taken letters in their order; where the k-th differ, a transposition.
    flat_x, flat_y = x[met], y[taken]
    moved = np.bincount(np.repeat(every, count), weights=flat_x != flat_y, minlength=len(a)) / 2
    full = np.maximum(count, 1)
    jaro = np.where(count > 0, (count / m + count / n + (count - moved) / full) / 3, 0.0)
    wide = min(most, x.shape[1], y.shape[1])
    prefix = np.cumprod(x[:, :wide] == y[:, :wide], axis=1).sum(axis=1)
    return np.where(count > 0, jaro + prefix * weight * (1 - jaro), 0.0)


def scored(score: Scores, a: pd.Series, b: pd.Series) -> np.ndarray:
    """Scores of two columns; equal pairs are scored once."""
    place: dict[tuple[str, str], int] = {}
    at = [place.setdefault(pair, len(place)) for pair in zip(a.fillna(""), b.fillna(""), strict=True)]
    return score([p[0] for p in place], [p[1] for p in place])[np.array(at, dtype=np.int64)]


def pair_udf(score: Scores) -> Callable[[Column, Column], Column]:
    """An Arrow UDF of two text columns."""

    @pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scored(score, a, b), dtype="float64")

    return run


jaro_winkler_similarity = pair_udf(jaro_winklers)
fuzz_ratio = pair_udf(indel_ratios)
fuzz_token_set_ratio = pair_udf(token_set_ratios)
fuzz_token_sort_ratio = pair_udf(token_sort_ratios)
fuzz_partial_ratio = pair_udf(partial_ratios)
fuzz_partial_token_set_ratio = pair_udf(partial_token_set_ratios)
fuzz_weighted_ratio = pair_udf(weighted_ratios)


def scored_together(parts: dict[str, tuple[Scores, str, str]]) -> Column:
    """A struct of several scores of named columns, by one UDF that gets each column once."""
    columns = sorted({c for _, left, right in parts.values() for c in (left, right)})

    @pandas_udf(StructType([StructField(name, DoubleType()) for name in parts]))
    def run(*given: pd.Series) -> pd.DataFrame:
        own = dict(zip(columns, given, strict=True))
        return pd.DataFrame({name: scored(score, own[left], own[right]) for name, (score, left, right) in parts.items()})

    return run(*columns)
