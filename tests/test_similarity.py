"""Similarities on hand-computed values and against plain definitions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim


def pair(spark, f, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]


def test_native(spark):
    assert pair(spark, sim.levenshtein_ratio, "kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert pair(spark, sim.levenshtein_ratio, "", "") == 1 and pair(spark, sim.levenshtein_ratio, "a", "") == 0
    assert pair(spark, sim.length_ratio, "abcde", "a" * 13) == pytest.approx(5 / 13)
    arrays = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d", "e"], [])], "a array<string>, b array<string>, c array<string>")
    got = arrays.select(sim.jaccard(F.col("a"), F.col("b")), sim.containment(F.col("a"), F.col("b")), sim.jaccard(F.col("c"), F.col("c")), sim.containment(F.col("a"), F.col("c"))).first()
    assert list(got) == [2 / 5, 2 / 3, 1.0, 0.0]
    assert pair(spark, sim.ngram_jaccard, "abcd", "abce") == pytest.approx(1 / 3) and pair(spark, sim.ngram_jaccard, "ab", "ab") == 1
    assert pair(spark, sim.number_overlap, "a 1 2", "2 3 b") == pytest.approx(1 / 3) and pair(spark, sim.number_overlap, "a", "b") == 1
    assert [pair(spark, sim.number_agreement, a, b) for a, b in (("x", "y"), ("1 2", "2 1"), ("1 2", "2"), ("1", "x"))] == [-1, 2, 1, 0]
    assert pair(spark, sim.jaccard100, "", "1") == -1 and pair(spark, sim.jaccard100, "1 2", "2") == 50


def one(scores, a, b):
    return float(scores([a], [b])[0])


@pytest.mark.parametrize(("a", "b", "expected"), [("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133), ("", "", 1.0), ("a", "", 0.0), ("abxyzq", "abmnop", 0.6444)])
def test_jaro_winkler(spark, a, b, expected):
    assert one(sim.jaro_winklers, a, b) == pytest.approx(expected, abs=1e-4)
    assert pair(spark, sim.jaro_winkler_similarity, a, b) == pytest.approx(expected, abs=1e-4)


def plain_jaro_winkler(a, b):
    if a == b:
        return 1.0
    reach, free, left = max(max(len(a), len(b)) // 2 - 1, 0), set(range(len(b))), []
    for i, c in enumerate(a):
        j = next((j for j in sorted(free) if abs(i - j) <= reach and b[j] == c), None)
        if j is not None:
            free.discard(j)
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = [c for j, c in enumerate(b) if j not in free]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right, strict=True)) / 2) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def lcs(a, b):
    """By the table of all prefixes, a row at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        fresh = [0]
        for j, y in enumerate(b):
            fresh.append(row[j] + 1 if x == y else max(row[j + 1], fresh[j]))
        row = fresh
    return row[-1]


def plain_ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_partial(a, b):
    if not a or not b:
        return 100.0 * (a == b)
    best = 0.0
    for short, long in {(a, b), (b, a)}:
        if len(short) <= len(long):
            best = max([best, *(plain_ratio(short, long[max(i, 0) : i + len(short)]) for i in range(1 - len(short), len(long)))])
    return best


def plain_token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    join = lambda words: " ".join(sorted(words))
    core, left, right = join(x & y), join(x - y), join(y - x)
    one_, two = (f"{core} {rest}".strip() for rest in (left, right))
    if core and not (left and right):
        return 100.0
    return max([plain_ratio(one_, two), *([plain_ratio(core, one_), plain_ratio(core, two)] if core else [])])


TEXTS = st.lists(st.tuples(st.text("abc é𝄞", max_size=14), st.text("abc é𝄞", max_size=14)), min_size=1, max_size=12)


@settings(max_examples=120, deadline=None)
@given(TEXTS, st.sampled_from([0, 60, 64, 130]))
def test_scores_against_plain_definitions(pairs, more):
    pairs = [*pairs, ("ab c" * (more // 2), "b ca" * (more // 3))]  # some are longer than the bits of one number
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert sim.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in pairs]
    assert sim.indel_ratios(a, b) == pytest.approx([plain_ratio(x, y) for x, y in pairs])
    assert sim.token_set_ratios(a, b) == pytest.approx([plain_token_set(x, y) for x, y in pairs])
    assert sim.token_sort_ratios(a, b) == pytest.approx([plain_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) for x, y in pairs])
    assert sim.jaro_winklers(a, b) == pytest.approx([plain_jaro_winkler(x, y) for x, y in pairs])
    a, b = a[:-1], b[:-1]
    assert sim.partial_ratios(a, b) == pytest.approx([plain_partial(x, y) for x, y in pairs[:-1]])
    for f in (sim.partial_token_set_ratios, sim.weighted_ratios):
        assert all(0 <= x <= 100 for x in f(a, b)) and f(a, b) == pytest.approx(f(b, a))


def test_fuzzy_values():
    assert one(sim.indel_ratios, "this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert one(sim.token_sort_ratios, "fuzzy was a bear", "was bear a fuzzy") == 100
    assert one(sim.token_set_ratios, "fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert one(sim.partial_ratios, "test", "this is a test!") == 100
    assert one(sim.token_set_ratios, "", "a") == 0 and one(sim.weighted_ratios, "", "") == 0
    assert all(len(f([], [])) == 0 for f in (sim.indel_ratios, sim.token_set_ratios, sim.partial_ratios, sim.weighted_ratios, sim.jaro_winklers))


def test_scores_together(spark):
    df = spark.createDataFrame([("a b", "b c", "x"), (None, "b", ""), ("a b", "b c", "y")], "l string, r string, z string")
    got = df.select(sim.scored_together({"one": (sim.indel_ratios, "l", "r"), "two": (sim.token_set_ratios, "r", "z")}).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in got] == [(one(sim.indel_ratios, x or "", y), one(sim.token_set_ratios, y, z)) for x, y, z in [("a b", "b c", "x"), (None, "b", ""), ("a b", "b c", "y")]]
