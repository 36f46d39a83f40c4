"""op1 against brute force, with every awkward row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import ann


def product(x, y):
    total = 0.0  # in order; sum() would compensate
    for a, b in zip(x, y, strict=True):
        total += a * b
    return total


def brute(rows, k, is_query):
    by = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        by[i] = min(by.get(i, v), v)
    out = {}
    for q, x in by.items():
        if is_query(q):
            scored = [(-product(x, y), c) for c, y in by.items() if c != q and len(y) == len(x)]
            out[q] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


def run(spark, rows, k=20, tiling=ann.Tiling(queries=7, shard=16, strip=5)):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int") if rows and len(rows[0]) == 4 else spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k, tiling=tiling).orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


def test_matches_brute_force_with_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(5)
    vectors = [list(map(float, np.round(rng.normal(size=8), 1))) for _ in range(90)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(100 + i, vectors[3]) for i in range(60)]  # a third are copies
    rows += [(200, None), (220, [0.0] * 8), (221, [1.0, None] * 4), (222, [float("nan")] * 8), (223, [float("inf")] + [1.0] * 7), (None, vectors[0])]
    rows += [(240, [1.0, 2.0]), (241, [3.0, -1.0]), (40, vectors[40]), (60, [-9.0] * 8)]
    expected = brute(rows, 20, lambda q: q % 20 == 0)
    got = run(spark, rows)
    assert set(got) == {q for q, own in expected.items() if own}
    for q, own in got.items():
        assert [c for c, _ in own] == [c for c, _ in expected[q]]
        assert [s for _, s in own] == pytest.approx([s for _, s in expected[q]], abs=1e-12)


def test_few_candidates_empty_table_and_clashing_names(spark):
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    assert run(spark, [(0, [1.0, 0.0], 5.0, 1), (1, [0.5, 0.5], 6.0, 2)]) == {0: [(1, 0.5)]}
    assert spark.createDataFrame([], "vec_id long, embedding array<float>").transform(lambda d: ann.nearest(d, F.col("vec_id") % 20 == 0)).count() == 0


def test_quantised_bounds_hold():
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(40, 16)) * 10 ** rng.uniform(-6, 6, (40, 1)), rng.normal(size=(50, 16)) * 10 ** rng.uniform(-6, 6, (50, 1))
    qc, qs, qn, qr = ann.quantise(q)
    cc, cs, _, cr = ann.quantise(c)
    middle = (qc.astype(float) @ cc.astype(float).T) * qs[:, None] * cs[None]
    error = qr[:, None] * np.linalg.norm(c, axis=1)[None] + qn[:, None] * cr[None]
    assert (np.abs(q @ c.T - middle) <= error * (1 + 1e-9)).all()
