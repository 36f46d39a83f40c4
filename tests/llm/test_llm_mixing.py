"""op6: budgets by hand and against a loop, selections as prefixes."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from linkloom.llm import mixing


def fill(budget, children):
    """Water-filling by repetition: children (name, weight, limit)."""
    given, open_ = {}, {n: (w, c) for n, w, c in children if w > 0}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c <= budget * w / total]
        if not full:
            return given | {n: budget * w / total for n, (w, _) in open_.items()} | {n: 0.0 for n, w, _ in children if w <= 0}
        for n in full:
            given[n] = open_.pop(n)[1]
            budget -= given[n]
    return given | {n: 0.0 for n, w, _ in children if w <= 0}


def test_share_out_is_water_filling(spark):
    import random

    rng = random.Random(3)
    for _ in range(6):
        kids = [(f"k{i}", rng.choice([0.0, 1.0, 2.5, 4.0]), float(rng.randint(0, 50))) for i in range(rng.randint(1, 7))]
        budget = float(rng.randint(0, 120))
        df = spark.createDataFrame([("p", budget, *k) for k in kids], "p string, budget double, name string, weight double, limit double")
        got = {r["name"]: r["given"] for r in mixing.share_out(df, ["p"], ["name"]).collect()}
        expected = fill(budget, kids)
        assert all(abs(got[n] - v) < 1e-6 for n, v in expected.items()), (kids, budget)


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("books", "en", "c", 1000)]
    df = spark.createDataFrame(leaves, "domain string, language string, src string, supply long")
    targets = mixing.Targets(domains={"web": 1.0, "books": 1.0}, languages={}, max_epochs=1, share=0.5)
    got = {r["src"]: r["budget"] for r in mixing.budgets(df, targets).collect()}
    assert got == {"a": 10, "b": 492, "c": 502} and sum(got.values()) in (1004, 1005)


def documents(spark):
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), ["en", "de", None][i % 3], f"src{i % 5}" if i % 11 else None, 3) for i in range(200)]
    rows += [(i, "hot " * 9, "en", "src0", 3) for i in range(200, 320)] + [rows[5], rows[5]] + [(400, None, "en", "src0", 3), (401, "", "en", "src1", 3), (None, "no id", "fr", "odd", 3), (402, "long " * 50_000, "es", "src2", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epochs int"), rows


def test_selection_is_a_seeded_prefix_that_meets_the_budget(spark):
    df, rows = documents(spark)
    targets = mixing.Targets(seed=17)
    got = mixing.mix(df, targets).collect()
    assert len(got) == len(set(rows))
    leaves = {}
    for r in got:
        leaves.setdefault((r["domain"], r["language"], r["src"]), []).append(r)
    for own in leaves.values():
        supply = sum(r["n_tokens"] for r in own)
        budget = own[0]["budget"]
        assert budget <= supply * targets.max_epochs
        assert sum(r["n_tokens"] * r["epochs"] + r["extra_tokens"] for r in own) == budget
        order = sorted(own, key=lambda r: (hashlib.md5("-".join(str(x) for x in (17, r["epochs"], r["doc_id"]) if x is not None).encode()).hexdigest(), r["doc_id"] or 0))
        left = budget - own[0]["epochs"] * supply
        for r in order:
            assert r["extra_tokens"] == max(0, min(r["n_tokens"], left))
            left -= r["n_tokens"]


def test_mixed_documents_repeat_and_keep_columns(spark):
    df, rows = documents(spark)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    expected = Counter()
    text_of = {(r[0], mixing_hash): r for r, mixing_hash in ((tuple(r)[:-1], r["h"]) for r in df.withColumn("h", F.xxhash64("text")).collect())}
    for r in mixing.mix(df).where("n_tokens > 0").collect():
        own = text_of[r["doc_id"], r["text_hash"]]
        expected[own] += r["epochs"] + (r["extra_tokens"] == r["n_tokens"])
        if 0 < r["extra_tokens"] < r["n_tokens"]:
            expected[own[0], " ".join(own[1].split()[: r["extra_tokens"]]), *own[2:]] += 1
    got = Counter(map(tuple, out.collect()))
    assert got == +expected
    assert sum(len(r[1].split()) * n for r, n in got.items()) == sum(r["budget"] for r in mixing.mix(df).select(*mixing.LEAF, "budget").distinct().collect())
    sized = mixing.mixed_documents(df, length="epochs").collect()
    assert all(r["epochs"] == len(r["text"]) for r in sized)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    nothing = mixing.mix(df, mixing.Targets(domains={}, languages={}, other=0.0))
    assert nothing.where("epochs > 0 OR extra_tokens > 0").count() == 0


def test_first_words(spark):
    texts = ["a b  c\td", "  a b c ", "a", " \n a\x0bb ", "é 𝄞x  y"]
    rows = [(t, n) for t in texts for n in range(1, len(t.split()) + 1)]
    for t, n, got in spark.createDataFrame(rows, "t string, n long").select("t", "n", mixing.first_words(F.col("t"), F.col("n"))).collect():
        words = t.split()
        assert t.startswith(got) and got.split() == words[:n] and not got[-1].isspace()
