"""op4 against a plain reading, and its rules against each other."""

import re
import time
from itertools import accumulate

from linkloom.llm import licenses
from linkloom.llm.license_rules import RULES, Rule

LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


def brute(text, rules=RULES):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    norm = f" {' '.join(words)} "
    found = []
    for order, r in enumerate(rules):
        for m in re.finditer(f" (?:{r.regex})(?= )", norm):
            begin = norm[: m.start()].count(" ")
            found.append((begin, begin + m[0].count(" "), r.priority, order, r.label))
    kept = {}
    for b, e, p, o, label in found:
        inside = any(B <= b and e <= E and P >= p and ((B, E, P, O) != (b, e, p, o)) and ((B, E) != (b, e) or P > p or O < o) for B, E, P, O, _ in found)
        if not inside:
            kept[label] = max(kept.get(label, 0), licenses.SCORES[p])
    base = {label for _, label in places}
    score = max([*kept.values(), licenses.SCORES[1] if places else 0.0, 0.0])
    at = sorted(i for i, _ in places)
    return (len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(base | set(kept))), score)


TEXTS = [
    None, "", "nothing here", "Licensed under CC BY-NC 4.0.\nX", "This work is licensed under the GNU General Public License, version 3.", "MIT License; mit license again, and Éa cc  by", "𝄞 a b Released under the MIT License. Licensed under the Apache License, Version 2.0.",
    "the gnu lesser general public license v2.1 and the GNU LESSER general public license", "xmit license mit licensee cc-by cc_by cc\x00by ccby", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the MIT License)",
    "SPDX-License-Identifier: Apache-2.0 OR MIT", "Apache license, BSD 3-Clause; all rights reserved", "mit license " * 300, "İ mit license", "all rights reserved proprietary and confidential all rights reserved",
]


def test_texts_match_brute_force(spark):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, (None, TEXTS[3], "x", 1.0)], "doc_id long, text string, norm string, score double")
    out = licenses.scan(df).collect()
    assert len(out) == len(rows) + 1
    for r in out:
        text = TEXTS[3 if r["doc_id"] is None else r["doc_id"]]
        assert tuple(r)[1:] == brute(text), text
    assert licenses.scan(df.limit(0)).count() == 0


def test_many_places_take_time_in_proportion(spark):
    n = 200_000
    df = spark.createDataFrame([(1, "mit license and " * n), (2, "gnu general public license, " * n)], "doc_id long, text string")
    begin = time.monotonic()
    one, two = sorted(licenses.scan(df).collect())
    assert time.monotonic() - begin < 60
    assert (one["n_base"], one["first_word"], one["last_word"], one["base_labels"]) == (n, 0, 3 * n - 3, "mit")
    assert (two["n_base"], two["first_word"], two["last_word"], two["base_labels"]) == (n, 0, 4 * n - 4, "gpl")


def test_running_sums(spark):
    rows = [([],), ([5],), (list(range(1, 38)),), ([1] * 1000,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<int>").selectExpr(licenses._running("v")).collect()]
    assert got == [list(accumulate(v)) for (v,) in rows]


def test_rules_are_many_and_gated():
    assert len(RULES) > 200
    gate = re.compile(licenses.prefilter(RULES))
    for r in RULES:
        assert gate.search(f"x {r.keyword} y") and r.keyword[0] != " "
        re.compile(r.regex)


def test_priority_and_containment(spark):
    rules = [Rule(1, "long", "a b", "a b c d"), Rule(2, "inner", "b c", "b c"), Rule(1, "weak", "b c", "b c"), Rule(1, "same", "a b", "a b c d")]
    df = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert licenses.scan(df, rules=rules).first()["labels"] == "inner,long"
    assert brute("a b c d e", rules)[5] == "inner,long"
