"""op9: fingerprints, the Golay keys' guarantee, links and components against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import xxhash

from linkloom.llm import components, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \t", "One", "one TWO", "a b c d", "É a\u00a0b c\x1cd é", "x y z " * 500):
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_spark_has_the_same_hash(spark):
    assert spark.sql("SELECT xxhash64('one two three')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", seed=42)


def test_golay_words_within_two_bits_share_a_codeword():
    table = simhash._golay_table()
    assert (table >= 0).sum(axis=1).max() == 6
    flips = np.array([sum(1 << b for b in bits) for n in (0, 1, 2) for bits in combinations(range(23), n)])
    rng = random.Random(1)
    for word in [rng.getrandbits(23) for _ in range(300)]:
        own = set(simhash.golay_indices(np.array([word]))[0]) - {-1}
        assert all(own & set(row) for row in simhash.golay_indices(word ^ flips))


def test_every_link_shares_a_key():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        rows, keys = simhash.fingerprint_keys(np.array([a, b], dtype=np.uint64).astype(np.int64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def brute_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(sorted(set(values)), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {v: root(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def cluster(rng, n, start):
    """Fingerprints in chains and clouds."""
    out = [start]
    while len(out) < n:
        base = rng.choice(out)
        for bit in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
            base ^= 1 << bit
        out.append(base)
    return out


def test_links_connect_as_brute_force_does(spark):
    rng = random.Random(3)
    values = sorted(set(cluster(rng, 150, rng.getrandbits(64)) + cluster(rng, 40, 0) + [rng.getrandbits(64) for _ in range(100)]))
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(4)
    expected = brute_components(values)
    for cap in (2, 64):  # crowded keys go the other way
        pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(nodes, cap).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
        roots = {r["node"] % (1 << 64): r["root"] for r in components.components(simhash.links(nodes, cap)).collect()}
        groups = {}
        for v in values:
            groups.setdefault(roots.get(v, ("own", v)), set()).add(expected[v])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (2000, 1999)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50)) and got[2000] == 1999
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    base = " ".join(f"word{i} of{i % 7}" for i in range(400))
    rows = [(5, base), (3, base), (9, base.replace("word7 ", "wort7 ")), (4, None), (2, " "), (None, base), (8, "alone here now"), (8, "alone here now"), (11, "w " * 200_000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.report(df).collect()]
    ids = brute_components([brute_fingerprint(t) for _, t in rows])
    least = {}
    for i, t in rows:
        r = ids[brute_fingerprint(t)]
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    assert sorted(got, key=str) == sorted([(i, f"{brute_fingerprint(t):016x}", least[ids[brute_fingerprint(t)]]) for i, t in rows], key=str)
    assert simhash.report(df.limit(0)).count() == 0


def test_hot_keys_are_sent_to_their_rows(spark, monkeypatch):
    """With a low bar for hot keys the results are the same."""
    from linkloom.llm import common

    rows = spark.createDataFrame([(i % 7 if i % 3 else 100, i) for i in range(300)], "k long, x long")
    right = rows.groupBy("k").count().withColumn("y", rows.k * 2).where("k <> 5")
    plain = {how: sorted(map(tuple, rows.join(right, "k", how).collect()), key=str) for how in ("inner", "left")}
    for least, most in ((10_000, 1000), (30, 1000), (1, 3)):
        monkeypatch.setattr(common, "LEAST_HOT", least)
        monkeypatch.setattr(common, "MOST_HOT", most)
        for how, expected in plain.items():
            assert sorted(map(tuple, common.join_hot(rows, right, ["k"], "count", how).collect()), key=str) == expected
        docs = spark.createDataFrame([(i, "one two three four" if i % 2 else f"w{i} a b c d") for i in range(60)], "doc_id long, text string")
        assert {r["component_id"] for r in simhash.report(docs).where("doc_id % 2 = 1").collect()} == {1}


def test_rounds_and_one_task_find_the_same_components(spark, monkeypatch):
    rng = random.Random(14)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    df = spark.createDataFrame(edges + [(None, 3), (7, 7)], "a long, b long").repartition(5)
    whole = {tuple(r) for r in components.components(df).collect()}
    monkeypatch.setattr(components, "FEW", 0)
    assert {tuple(r) for r in components.components(df).collect()} == whole and (1200, 1000) in whole
    assert components.components(df.limit(0)).count() == 0
    monkeypatch.setattr(components, "FEW", 380)  # rounds first, then one task
    assert {tuple(r) for r in components.components(df).collect()} == whole
    words = spark.createDataFrame([("b", "a"), ("b", "é"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in components.components(words).collect()} == {("a", "a"), ("b", "a"), ("é", "a"), ("x", "x"), ("y", "x")}
