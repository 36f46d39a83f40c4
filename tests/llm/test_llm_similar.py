"""The pipeline's near-duplicates: recall at 0.8 and above, large groups, and components against brute force."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import similar


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """The place of the first text of each one's component."""
    sets, root = [brute_set(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        if (len(sets[i] & sets[j]) / union if union else 1.0) >= 0.8 and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


def made(rng, n):
    return [f"w{rng.randrange(50_000)}" for _ in range(n)]


def test_pairs_at_the_limit_share_a_key():
    rng = random.Random(5)
    for n, edits in ((200, 4), (60, 1), (500, 10), (2000, 42)):
        for _ in range(60):
            base = made(rng, n)
            a, b = (similar.shingles(" ".join(w)) for w in (base, edited(rng, base, edits)))
            if similar.jaccard(a, b) >= 0.8:
                assert set(similar.band_keys(a)) & set(similar.band_keys(b))


def test_the_stage_drops_near_copies_at_four_fifths(spark):
    rng = random.Random(6)
    bases = [made(rng, 200) for _ in range(40)]
    rows = [(i, " ".join(b), "en", "s", 1) for i, b in enumerate(bases)] + [(100 + i, " ".join(edited(rng, b, 4)), "en", "s", 1) for i, b in enumerate(bases)]
    rows += [(200 + i, " ".join(edited(rng, b, 12)), "en", "s", 1) for i, b in enumerate(bases)]  # these stay
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted(rows[i][0] for i in set(brute_groups([r[1] for r in rows])))
    assert sum(100 <= i < 200 for i in got) < 5 and sum(i >= 200 for i in got) == 40


def test_components_are_those_of_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    texts = []
    for n in (30, 80, 200):
        base = made(rng, n)
        texts += [" ".join(edited(rng, base, rng.randrange(0, max(2, n // 25)))) for _ in range(45)]
    texts += ["", None, " \t", "one", "One", "one two three", "a b c d e"] + [" ".join(made(rng, 40)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = brute_groups(texts)
    monkeypatch.setattr(similar, "BLOCK", 16)  # many blocks for a crowded key
    for cap in (2, 64):
        got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(df, bucket_cap=cap).collect()}
        assert [got[i] for i in range(len(texts))] == expected
    assert similar.near_duplicates(df.limit(0)).count() == 0


def test_large_tight_groups_need_no_blocks(spark, monkeypatch):
    """Copies with an edit each, and two such groups under one key, are settled by pivots."""
    rng = random.Random(8)
    base = made(rng, 300)
    texts = [" ".join(edited(rng, base, 2)) for _ in range(300)]
    monkeypatch.setattr(similar, "_block_links", lambda crowd, sets, least: crowd.where(F.raise_error(F.concat(F.lit("block of "), F.col("key").cast("string"))).isNull()).select(F.col("node").alias("a"), F.col("node").alias("b")))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["component_id"] for r in similar.near_duplicates(df).collect()} == {0}


def test_crowds_by_pivots_and_blocks(spark, monkeypatch):
    """Sets that drift away from the pivot step by step: links run between members of different stars."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    rng = random.Random(9)
    sets, ids = {}, 0
    for _ in range(3):
        words = [rng.randrange(1 << 60) for _ in range(60)]
        for step in range(25):
            for w in rng.sample(range(60), rng.choice([1, 2, 4, 4, 12])):
                words[w] = rng.randrange(1 << 60)
            sets[ids] = np.sort(np.array(words, dtype=np.uint64))
            ids += 1
    order = list(sets)
    rng.shuffle(order)
    sets = {new: sets[old] for new, old in enumerate(order)}
    rows = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "node long, own binary")
    crowd = spark.createDataFrame([(5, k) for k in sets], "key long, node long")
    true = [(a, b) for a, b in combinations(sets, 2) if similar.jaccard(sets[a], sets[b]) >= 0.8]
    pairs = [(r["a"], r["b"]) for df in similar._crowd_links(crowd, rows, 0.8) for r in df.collect()]
    assert parts(sets, pairs) == parts(sets, true) and len({*parts(sets, true).values()}) > 6


def parts(nodes, pairs):
    root = {n: n for n in nodes}
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_loose_groups_are_those_of_brute_force(spark, monkeypatch):
    """Copies of one text with so many edits that some pairs reach the limit and most don't."""
    rng = random.Random(11)
    base = made(rng, 120)
    texts = [" ".join(edited(rng, base, rng.choice([1, 2, 3, 4, 6]))) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = brute_groups(texts)
    assert 3 < len(set(expected)) < 80
    for block in (8, 1024):
        monkeypatch.setattr(similar, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(df).collect()}
        assert [got[i] for i in range(len(texts))] == expected


def test_blocks_compare_across_sides():
    a = np.arange(10, dtype=np.uint64)
    sets = [a, a[:9], np.arange(50, 60, dtype=np.uint64), a[1:]]
    assert similar.block_links(sets, np.array([0, 0, 0, 0]), 0.8).tolist() == [0, 0, 2, 0]
    assert similar.block_links(sets, np.array([0, 0, 1, 1]), 0.9).tolist() == [0, 1, 2, 0]


def stages_of(spark, run):
    """How many stages ran while run() did."""
    group = f"stages-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setJobGroup("other", "other")
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(1 for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks)


def test_small_loose_groups_take_few_stages(spark, monkeypatch):
    """Whatever a stage reads, it costs a file or more for each task; what is small needs no way around hot keys and no rounds of stars."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    rng = random.Random(12)
    base = made(rng, 120)
    texts = [" ".join(edited(rng, base, rng.choice([3, 4, 5, 6]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = []
    n = stages_of(spark, lambda: got.extend(similar.near_duplicates(df).collect()))
    found = {r["doc_id"]: r["component_id"] for r in got}
    assert [found[i] for i in range(len(texts))] == brute_groups(texts)
    assert n < 180


def test_pivots_stop_where_they_link_next_to_none(spark, monkeypatch):
    """A key of loose sets has one round of pivots; beside it a key of tight ones goes on until all are linked."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    rng = random.Random(13)
    made_of = lambda words, n: np.sort(np.array(words[n:] + [rng.randrange(1 << 60) for _ in range(n)], dtype=np.uint64))
    base, *tight = ([rng.randrange(1 << 60) for _ in range(100)] for _ in range(4))
    sets = {i: made_of(base, 20) for i in range(40)} | {100 + i: made_of(tight[i % 3], 2) for i in range(39)}
    rows = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "node long, own binary")
    crowd = spark.createDataFrame([(5 if k < 100 else 6, k) for k in sets], "key long, node long")
    compared, plain = [], similar._similarities
    monkeypatch.setattr(similar, "_similarities", lambda pairs, sets: compared.append(pairs.count()) or plain(pairs, sets))
    pairs = [(r["a"], r["b"]) for df in similar._crowd_links(crowd, rows, 0.8) for r in df.collect()]
    true = [(a, b) for a, b in combinations(sets, 2) if similar.jaccard(sets[a], sets[b]) >= 0.8]
    assert parts(sets, pairs) == parts(sets, true) and len({*parts(sets, true).values()}) == 43
    assert compared[0] == 39 + 38 and max(compared[1:]) < 39
