"""Licence scan by ordered signature rules, in DataFrame functions alone.

A text is first held to one prefilter regex that any rule's or base phrase's match also
passes; only what passes is cut into words. Of the rules, those run whose keyword
the words contain. All their matches are intervals of words. A match inside another's interval is
suppressed unless its rule has the higher priority; of matches on one interval the rule of the
higher priority stays, then the one listed first. The labels of what stays are added to those
of the base phrases.

Defined results: null text counts as empty; empty text has no words, no places, labels '', score 0;
repeated rows are judged alike; no rows give no rows; other columns never matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.license_rules import RULES, Rule

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
SCORES = {3: 1.0, 2: 0.9, 1: 0.6}
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_PATTERN = f" (?:{'|'.join(BASE)})(?= )"


def _branches(words: list[str]) -> str:
    """A regex for any of the words that tries each letter once: a tree of their common beginnings."""
    if "" in words:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    own = [(APART + "+" if c == " " else c) + _branches(rest) for c, rest in sorted(by.items())]
    return own[0] if len(own) == 1 else f"(?:{'|'.join(own)})"


def prefilter(rules: list[Rule]) -> str:
    """A regex on the raw text that finds something wherever a keyword or base phrase begins among its words."""
    return "(?i)(?<![0-9a-z])" + _branches(sorted({r.keyword for r in rules} | set(BASE)))


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_table(rules: list[Rule]) -> str:
    rows = [{"o": i, "p": r.priority, "l": r.label, "k": r.keyword, "r": f" (?:{r.regex})(?= )"} for i, r in enumerate(rules)]
    return f"from_json({_quoted(json.dumps(rows))}, 'array<struct<o:int,p:int,l:string,k:string,r:string>>')"


def _base_places(regex: str) -> str:
    """n, first and last: how often a regex matches in ``norm``, and the words at which the first and last match begin."""
    found, parts = f"regexp_extract_all(norm, {regex}, 0)", f"split(norm, {regex}, -1)"
    last = f"{_spaces('norm')} - {_spaces('element_at(b.parts, -1)')} - {_spaces('element_at(b.found, -1)')}"
    return f"transform(array(struct({found} AS found, {parts} AS parts)), b -> struct(size(b.found) AS n, {_spaces('b.parts[0]')} AS first, {last} AS last))[0]"


def _running(numbers: str) -> str:
    """Running sums of an array, by doubling: each round adds what stands 1, 2, 4, ... places before."""
    rounds = f"sequence(0, greatest(0, cast(ceil(log2(size({numbers}) + 1)) AS int)))"
    return f"aggregate({rounds}, {numbers}, (acc, k) -> transform(acc, (v, i) -> v + if(i >= shiftleft(1, k), acc[i - shiftleft(1, k)], 0)))"


def _places(regex: str) -> str:
    """Array of (s, e): the intervals of words that a regex matches in ``norm``."""
    found, parts = f"regexp_extract_all(norm, {regex}, 0)", f"split(norm, {regex}, -1)"
    # A match begins after the words of all parts and matches before it.
    steps = f"transform(x.found, (m, i) -> struct({_spaces('x.parts[i]')} + if(i > 0, {_spaces('x.found[i - 1]')}, 0) AS step, {_spaces('m')} AS own))"
    ends = "transform(y.steps, (z, i) -> struct(y.begins[i] AS s, y.begins[i] + z.own AS e))"
    with_steps = f"transform(array(struct({found} AS found, {parts} AS parts)), x -> {steps})"
    with_begins = f"transform({with_steps}, w -> struct(w AS steps, {_running('transform(w, z -> z.step)')} AS begins))"
    return f"flatten(transform({with_begins}, y -> {ends}))"


def _kept(matches: str) -> str:
    """Labels and best score of the matches that aren't suppressed.

    In the order of begin, then end from far to near, whatever holds a match comes before it; so it is
    inside another of priority p or more iff the furthest end so far of such priorities reaches its own.
    """
    reach = {p: f"greatest({', '.join(f'acc.m{q}' for q in range(p, 4))}, -1)" for p in (1, 2, 3)}
    covered = "CASE " + " ".join(f"WHEN -x.np = {p} THEN {reach[p]} >= -x.ne" for p in (1, 2, 3)) + " ELSE false END"
    score = "CASE " + " ".join(f"WHEN -x.np = {p} THEN {s}D" for p, s in SCORES.items()) + " ELSE 0D END"
    ends = ", ".join(f"greatest(acc.m{p}, if(-x.np = {p}, -x.ne, -1)) AS m{p}" for p in (1, 2, 3))
    step = f"(acc, x) -> struct({ends}, if({covered}, acc.labels, array_union(acc.labels, array(x.l))) AS labels, if({covered}, acc.score, greatest(acc.score, {score})) AS score)"
    start = "struct(-1 AS m1, -1 AS m2, -1 AS m3, cast(array() AS array<string>) AS labels, 0D AS score)"
    return f"aggregate(array_sort({matches}), {start}, {step}, acc -> struct(acc.labels AS labels, acc.score AS score))"


def scan(docs: DataFrame, keep: list[str] = ["doc_id"], rules: list[Rule] = RULES) -> DataFrame:
    """The columns ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce("text", F.lit(""))
    passes: Column = text.rlike(prefilter(rules))
    words = F.translate(F.regexp_replace(text, APART + "+", " "), UPPER, LOWER)
    norm = F.when(passes, F.concat(F.lit(" "), F.trim(words), F.lit(" ")))
    # Exploding an array of one keeps the optimizer from copying the expression to each place that uses norm.
    rows = docs.select(*keep, F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.explode(F.array(norm)).alias("norm"))
    base = _quoted(BASE_PATTERN)
    one = lambda name, value: F.explode(F.array(F.expr(value))).alias(name)
    rows = rows.select("*", one("_base", f"CASE WHEN norm IS NOT NULL AND norm RLIKE {base} THEN {_base_places(base)} END"))
    active = f"filter({_rule_table(rules)}, r -> contains(norm, concat(' ', r.k)))"
    matches = f"flatten(transform({active}, r -> transform({_places('r.r')}, y -> struct(y.s AS s, -y.e AS ne, -r.p AS np, r.o AS o, r.l AS l))))"
    rows = rows.select("*", one("_rules", f"CASE WHEN norm IS NOT NULL THEN {_kept(matches)} END"))
    labels = F.array_compact(F.array(*(F.when(F.col("norm").contains(f" {phrase} "), F.lit(label)) for phrase, label in BASE.items())))
    own = F.when(F.col("_base").isNotNull(), labels).otherwise(F.array().cast("array<string>"))
    all_labels = F.array_sort(F.array_union(own, F.coalesce(F.col("_rules.labels"), F.array().cast("array<string>"))))
    return rows.select(
        *keep,
        "n_words",
        F.coalesce("_base.n", F.lit(0)).cast("long").alias("n_base"),
        F.col("_base.first").cast("long").alias("first_word"),
        F.col("_base.last").cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.col("_rules.score"), F.lit(0.0)), F.when(F.col("_base").isNotNull(), F.lit(SCORES[1])).otherwise(F.lit(0.0))).alias("score"),
    )
