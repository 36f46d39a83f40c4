"""Operators of record linkage on small cases, and against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.functions.text import fast_records, normalized_records
from linkloom.functions.translit import prepared
from linkloom.operators import blocking, evaluation, models, pairs, sampling, selection, siblings, tfidf
from linkloom.plans import flows
from linkloom.sources import io

SCHEMA = "entity_id string, business_name string, business_address string, country string"
S1 = [("S1-001", "Acme Corporation", "123 Main St", "US"), ("S1-002", "Apex Logistics Ltd", "45 Industrial Rd", "India")]
S2 = [("S2-001", "ACME Corp", "123 Main Street", "USA"), ("S2-002", "Other Company", "9 Nowhere", "US")]
S3 = [("S3-001", "Apex Logistics Pvt Ltd", "45 Industrial Road", "IND")]


def records(spark, rows):
    return normalized_records(spark.createDataFrame(rows, SCHEMA))


def test_candidates_of_the_small_example(spark):
    got = {r["s1_id"]: r["candidates"] for r in blocking.generate_candidates(records(spark, S1), records(spark, S2), records(spark, S3)).collect()}
    assert "S2-001" in got["S1-001"] and "S2-002" not in got["S1-001"] and "S3-001" in got["S1-002"]
    empty = blocking.generate_candidates(records(spark, S1), records(spark, S2).limit(0), records(spark, S3).limit(0))
    assert all(r["candidates"] == [] for r in empty.collect())


def test_keys(spark):
    got = {(r["blocker"], r["key"]) for r in blocking.blocking_keys(records(spark, [("S1-1", "Blue Star Hotel", "12 Park Lane 560001", "India")])).collect()}
    assert {("name_exact", "exact_name#blue star hotel"), ("name_compact", "compact_name#bluestarhotel"), ("name_token", "token#blue"), ("name_ngram", "ngram3#blu"), ("address_anchor", "addr_num#12"), ("address_anchor", "addr_token#park"), ("country_assisted", "country_token#INDIA#blue"),
            ("composite_key", "INDIA#name_first#blue"), ("composite_key", "INDIA#name_prefix#blue"), ("composite_key", "INDIA#name_sec#star"), ("composite_key", "INDIA#num_name#12#blu"), ("composite_key", "INDIA#zip_name#560001#blu"), ("composite_key", "INDIA#addr_nums#12#560001")} <= got
    blocking.register_blocker("first_letter", lambda: blocking.only(F.col("name_norm") != "", F.substring("name_norm", 1, 1)))
    try:
        assert ("first_letter", "b") in {(r["blocker"], r["key"]) for r in blocking.blocking_keys(records(spark, [("S1-1", "Blue", "", "")])).collect()}
    finally:
        del blocking.BLOCKERS["first_letter"]


def test_crowded_keys_are_pruned(spark):
    keys = spark.createDataFrame([(f"e{i}", "b", "hot") for i in range(30)] + [("e1", "b", "cold")], "entity_id string, blocker string, key string")
    pruned = blocking.pruned_keys(keys, 20)
    assert {r["key"] for r in pruned.collect()} == {"cold"}
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan  # rows of the crowded key move nowhere


def test_pair_features(spark):
    left, right = records(spark, [("S1-1", "Prime Money", "17560 Ellis Road", "US")]), records(spark, [("S2-1", "Prime Money LLC", "17560 Ellis Road", "USA")])
    got = pairs.pair_features(pairs.with_sides(spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, cand_id string"), left, right, pairs.SIDE)).first()
    assert got["name_norm_exact"] == 1 and got["combined_geom_sim"] > 0.7 and got["strong_disagreement"] == 0 and got["postal_code_match"] == 1 and got["strong_agreement"] == 1
    assert [c for c in pairs.FEATURES if got[c] is None] == []


def test_fast_features_and_flow(spark):
    raw = lambda rows: spark.createDataFrame(rows, SCHEMA)
    got = {(r["s1_id"], r["cand_id"]): r for r in flows.fast_pairs(raw(S1), raw(S2 + S3)).collect()}
    assert got["S1-001", "S2-001"]["name_exact"] == 1 and got["S1-001", "S2-001"]["country_match"] == 1 and ("S1-001", "S2-002") not in got
    assert fast_records(raw([("S1-1", None, None, None)])).first()["fast_name"] == ""
    cands, matches = flows.rule_flow(raw(S1), raw(S2 + S3))
    assert {(r["s1_id"], r["cand_id"]) for r in matches.collect()} == {("S1-001", "S2-001"), ("S1-002", "S3-001")}
    out, _ = flows.outputs(matches, cands, raw(S1 + [("S1-003", "Lone", "", "US")]))
    assert {tuple(r) for r in out.collect()} == {("S1-001", "S2-001"), ("S1-002", "S3-001"), ("S1-003", "")}


def loop_select(scores, threshold, gap, most):
    good = sorted(((-s, c) for c, s in scores if s >= threshold))[:most]
    return [c for s, c in good if -s >= max(threshold, -good[0][0] - gap)] if good else []


def test_selection_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(f"g{g}", f"c{i:02d}", round(rng.random(), 2)) for g in range(120) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, score double")
    for threshold, gap, most in ((0.7, 0.15, 10), (0.3, 0.3, 2), (0.0, 1.0, 3)):
        got = {}
        for r in selection.select_matches(df, threshold, gap, most).collect():
            got.setdefault(r["s1_id"], set()).add(r["cand_id"])
        for g in {r[0] for r in rows}:
            assert got.get(g, set()) == set(loop_select([(c, s) for x, c, s in rows if x == g], threshold, gap, most))
    small = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.85), ("a", "3", 0.5), ("b", "4", 0.6), ("b", "5", 0.59)], "s1_id string, cand_id string, score double")
    assert {r["cand_id"] for r in selection.select_matches(small, 0.7, 0.15).collect()} == {"1", "2"}


def test_expected_f(spark):
    rng = random.Random(2)
    rows = [(2, f"q{i}", f"s{rng.randrange(25)}", round(rng.random(), 3)) for i in range(200)]
    got = {(r["q_id"], r["s1_id"]) for r in selection.expected_f_select(spark.createDataFrame(rows, "src int, q_id string, s1_id string, p double")).collect()}
    expected = set()
    for s in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (-r[3], r[0], r[1]))
        total, none = sum(r[3] for r in own), np.prod([1 - min(r[3], 1 - 1e-6) for r in own])
        able = [r for r in own if r[3] >= 0.05]
        ef = [1.25 * sum(r[3] for r in able[: k + 1]) / (0.25 * total + k + 1) for k in range(len(able))]
        if ef and max(ef) > none:
            expected |= {(r[1], s) for r in able[: ef.index(max(ef)) + 1]}
    assert got == expected


def test_competition_of_a_single_candidate(spark):
    row = pairs.competition(spark.createDataFrame([(2, "q", "s", 0.8, 0.7, 0.9)], "src int, q_id string, s1_id string, score double, ncos double, acos double")).first()
    assert (row["rank"], row["gap_top"], row["margin"], row["n_cand_q"], row["n_top1_s1"]) == (1, 0.0, 0.8, 1, 1)


def test_collisions(spark):
    recs = spark.createDataFrame([("S1-1", "Blue Star", "1 Park", "US"), ("S1-2", "Red Moon", "2 Hill", "US"), ("S2-1", "blue star", "1 park", "US"), ("S2-2", "zzz", "qqq", "US"), ("S2-3", "x", "y", "US")], SCHEMA)
    matches = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-2"), ("S1-2", "S2-3")], "s1_id string, cand_id string")
    assert {tuple(r) for r in selection.resolve_collisions(matches, recs).collect()} == {("S1-1", "S2-1"), ("S1-2", "S2-3")}


def test_metrics(spark):
    lists = lambda d: spark.createDataFrame(list(d.items()), "s1_id string, ids array<string>")
    got = evaluation.evaluate_matching(lists({"a": ["47", "812"]}), lists({"a": ["47", "193", "812"]})).first()
    assert got["precision"] == pytest.approx(2 / 3) and got["recall"] == 1 and got["f05"] == pytest.approx(0.7142857)
    got = evaluation.evaluate_matching(lists({"a": ["1"], "b": [], "c": ["2"]}), lists({"a": ["1"], "c": []})).first()
    assert got["f05"] == pytest.approx(2 / 3) and got["singleton_accuracy"] == 1 and got["false_negatives"] == 1
    empty = lists({"a": ["1"]}).limit(0)
    assert evaluation.evaluate_matching(empty, empty).first()["f05"] == 1
    both = evaluation.evaluate_matching(lists({"a": ["1"], "b": ["2"]}), lists({"a": ["1"], "z": ["9"]}), scope="intersection").first()
    assert both["f05"] == 1
    blocked = evaluation.evaluate_blocking(lists({"a": ["1"], "b": ["2"], "c": [], "d": []}), lists({"a": ["1", "2"], "b": ["3"], "c": ["4", "5", "6"]}), 10).first()
    assert (blocked["recall"], blocked["median_candidates"], blocked["p95_candidates"], blocked["max_candidates"]) == (0.5, 2, 3, 3) and blocked["reduction_ratio"] == pytest.approx(1 - 6 / 40)


def test_validator(spark):
    rows = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-2", "S1-9,X-1,S3-7"), ("S1-8", "")], "s1_id string, list string")
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    cands = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-7")], "s1_id string, list string")
    got = {r["rule"]: (r["offenders"], r["examples"]) for r in evaluation.submission_findings(rows, required, known, cands).collect()}
    assert got == {"duplicate_rows": (1, "S1-1"), "repeated_ids": (1, "S1-1"), "self_matches": (1, "S1-9"), "wrong_prefix": (1, "X-1"), "missing_parents": (1, "S1-3"), "extra_parents": (1, "S1-8"), "unknown_ids": (1, "S3-7"), "matched_outside_candidates": (1, "S1-2")}


def test_integrity(spark):
    df = spark.createDataFrame([("S1-1", "a", "b", "US"), ("S1-1", "a", "", "US"), ("S1-1", "a", "b", ""), ("bad", "", "b", "US"), ("S2- ", "x", "y", "z")], SCHEMA)
    r = evaluation.integrity_report(df).first()
    assert (r["total"], r["n_duplicates"], r["duplicate_ids"], r["n_malformed"], r["malformed_ids"], r["empty_names"], r["empty_addresses"], r["empty_countries"], r["is_valid"]) == (5, 2, ["S1-1"], 2, ["S2- ", "bad"], 1, 1, 1, False)


def test_siblings(spark):
    made = [(2, "S2-1", "Blue Star", "12 Park Lane, Pune", "IN"), (2, "S2-2", "Blue Star", "99 Other Way", "IN"), (3, "S3-1", "Green", "1 X", "IN")]
    from linkloom.functions.translit import prepared

    recs = prepared(spark.createDataFrame(made, "src int, q_id string, business_name string, business_address string, country string"))
    p1 = spark.createDataFrame([(2, "S2-1", "S1-1", 0.9), (2, "S2-2", "S1-5", 0.2), (3, "S3-1", "S1-1", 0.6)], "src int, q_id string, s1_id string, p1 double")
    assert [tuple(r) for r in siblings.expand(p1, recs).collect()] == [(2, "S2-2", "S1-1", 2)]
    got = {r["q_id"]: r for r in siblings.sibling_features(p1, recs).collect()}
    assert got["S2-2"]["sib_rn"] == -2 and got["S2-2"]["n_sib"] == 0 and got["S2-1"]["n_sib"] == 1 and got["S2-1"]["ss_rn"] == -2


def test_stumps_and_logistic(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) | (x[:, 2] > 0.8)).astype(float)
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, label int")
    model = models.fit_stumps(x, y, names)
    total = np.full(len(y), model.start)
    for s in model.stumps:
        total += model.rate * np.where(x[:, names.index(s.feature)] <= s.threshold, s.low, s.high)
    scores = [r["score"] for r in model.score(df).collect()]
    assert scores == pytest.approx((1 / (1 + np.exp(-total))).tolist(), abs=1e-12) and len(model.stumps) == 50
    assert np.mean((np.array(scores) > 0.5) == y) > 0.85
    model.save(spark, f"{tmp_path}/m")
    assert models.StumpModel.load(spark, f"{tmp_path}/m") == model
    logistic = models.fit_logistic(df, names)
    assert np.mean((np.array([r["score"] for r in logistic.score(df).collect()]) > 0.5) == y) > 0.75
    logistic.save(spark, f"{tmp_path}/l")
    assert models.LogisticModel.load(spark, f"{tmp_path}/l") == logistic
    few = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    assert sorted(r["w"] for r in models.balanced(few, "label", "w").collect()) == pytest.approx([2 / 3, 2 / 3, 2 / 3, 2.0])


def test_trees_stop_early_and_tell_what_they_use(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), int(a > 0.5), bool(i % 4 == 0), i) for i, (a, b) in enumerate(rng.random((400, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, label int, is_val boolean, qhash int")
    model = models.fit_trees(df, ["a", "b"], F.lit(True), rounds=60)
    assert model.stages[-1].getNumTrees < 60
    used = models.feature_importance(model, ["a", "b"])
    assert used[0][0] == "a" and used[0][1] > 0.9
    assert models.with_probability(model, df, "p").where((F.col("p") > 0.5) == (F.col("label") == 1)).count() > 390


def test_unfitted_matcher(spark):
    df = spark.createDataFrame([(0.3,)], "combined_geom_sim double")
    assert models.FallbackMatcher().score(df).first()["score"] == 0.3


def test_threshold_tuning(spark):
    best = spark.createDataFrame([("a", "1", 0.9), ("a", "2", 0.4), ("b", "3", 0.3)], "s1_id string, cand_id string, p double")
    truth = spark.createDataFrame([("a", ["1"]), ("b", [])], "s1_id string, ids array<string>")
    got = dict(models.tune_threshold(best, truth, [0.2, 0.35, 0.5]))
    assert got[0.5] == 1.0 and got[0.2] < got[0.35] < 1.0
    threshold, f = models.search_threshold(best, truth)
    assert 0.4 < threshold <= 0.9 and f == 1.0


def test_sampling(spark):
    cands = spark.createDataFrame([("s", f"c{i}") for i in range(20)], "s1_id string, cand_id string")
    truth = spark.createDataFrame([("s", "c3")], "s1_id string, cand_id string")
    got = [r["label"] for r in sampling.training_pairs(cands, truth).collect()]
    assert sorted(got) == [0] * 3 + [1] * 2
    ids = spark.range(1000).selectExpr("id AS s1_id")
    a = {r[0] for r in sampling.uniform_sample(ids, 50, ["s1_id"]).collect()}
    assert len(a) == 50 and a == {r[0] for r in sampling.uniform_sample(ids.repartition(7), 50, ["s1_id"]).collect()}
    assert sampling.stratified_sample(ids, 40, F.col("s1_id") < 500).where("s1_id < 500").count() == 32


def test_url_model(spark):
    model = models.url_model(spark)
    urls = ["https://github.com/python/cpython", "http://paypal-login-verify.xyz/account/confirm", "http://10.9.8.7/apple/login/update.php"]
    got = {r["url"]: r["threat_score"] for r in models.url_predictions(model, spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got[urls[0]] < 0.5 <= min(got[urls[1]], got[urls[2]])


def test_prefix_of_sources():
    assert io.RECORD_COLUMNS[0] == "entity_id"


def test_rounding_twice_is_duckdbs(spark):
    """Scores of nine digits whose last three are 500: their products with a million lie on either side of a half."""
    import duckdb

    from linkloom.plans import registry

    values = [0.5081315, 0.5043515, 0.0163035, 0.0087025, 0.1234565, 0.2500005, 1.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(*registry._rounded_again(["x"])).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]


def _tfidf_sides(spark, n):
    s1 = prepared(spark.createDataFrame([(f"S1-{i:03d}", "Hot Ring Corporation", f"{i % 5} Large Street, Suite {1000 + i}", "US") for i in range(n)], SCHEMA)).withColumn("s1_id", F.col("entity_id"))
    queries = prepared(spark.createDataFrame([(f"S2-{i:03d}", "HOT RING Corp.", f"{i % 5} Large St Ste {1000 + i}", "US") for i in range(0, n, 2)], SCHEMA)).withColumns({"src": F.lit(2), "q_id": F.col("entity_id")})
    return queries, s1


def test_tfidf_where_a_channel_has_only_crowded_terms(spark):
    """All names are the same: with max_df below their number no term of a name is left."""
    queries, s1 = _tfidf_sides(spark, 60)
    report = {r["q_id"]: r for r in tfidf.cosine_report(queries, s1, ["q_id"], max_df=20).collect()}
    assert len(report) == 30 and all(r["total_ncos"] == 0 and r["n_pairs"] == 12 and r["best_acos"] > 0.99 for r in report.values())
    joined = tfidf.similarity_join(queries, s1, ["src", "q_id"], max_df=20).collect()
    assert {(r["q_id"][3:], r["s1_id"][3:]) for r in joined if r["acos"] > 0.99} == {(f"{i:03d}", f"{i:03d}") for i in range(0, 60, 2)}


def test_tfidf_matrices_grow_with_matches(spark):
    """Ten groups that share a term each: the matrices have hardly more cells than pairs share a term, and any cut gives the same products."""
    import pyarrow as pa

    rows = lambda n, tag: pa.table({"id": [f"{tag}{i}" for i in range(n)], "n_terms": [[i % 10, 1000 + i] for i in range(n)], "n_w": [[0.6, 0.8]] * n, "a_terms": pa.array([[]] * n, pa.list_(pa.int64())), "a_w": pa.array([[]] * n, pa.list_(pa.float64()))})
    n, cells, got = 1280, 0, {}
    for at, places, ncos, acos in tfidf.strips(rows(n, "q"), rows(n, "s")):
        cells += ncos.size
        assert ncos.dtype == acos.dtype == np.float64 and not acos.any()
        got.update({(int(at[i]), int(places[j])): float(ncos[i, j]) for i, j in zip(*np.nonzero(ncos), strict=True)})
    assert len(got) == n * n // 10 and cells <= 2 * len(got)
    assert all(abs(v - (1.0 if q == s else 0.36)) < 1e-12 and q % 10 == s % 10 for (q, s), v in got.items())


def test_best_places_take_ties_by_place():
    scores = np.array([[0.5, 0.9, 0.5, 0.5, 0.01], [0.0, 0.04, 0.0, 0.06, 0.0]])
    assert tfidf.best_places(scores, 2, 0.05).tolist() == [[True, True, False, False, False], [False, False, False, True, False]]


def test_records_of_a_small_file_are_dealt(spark):
    from linkloom.plans import entities

    rows = spark.range(entities.TASK_ROWS * 3, numPartitions=1)
    assert entities.dealt(rows, "id").rdd.getNumPartitions() == 3 and entities.dealt(rows, "id").count() == rows.count()
    assert entities.dealt(rows.limit(5), "id").count() == 5


def test_crowded_keys_of_sources_move_nowhere(spark):
    rows = lambda tag, n: spark.createDataFrame([(f"{tag}{i}", "name_exact", "hot") for i in range(n)] + [(f"{tag}1", "name_exact", "cold")], "entity_id string, blocker string, key string")
    found = blocking.candidates(rows("S1-", 9), rows("S2-", 30), 20)
    assert [(r["s1_id"], r["cand_id"], r["reasons"]) for r in found.collect()] == [("S1-1", "S2-1", ["name_exact"])]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 2


def _shuffled(spark, run):
    """Records that the shuffles of ``run`` write, read from Spark's own counters."""
    from pyspark.sql import functions as F

    store, before = spark.sparkContext._jsc.sc().statusStore(), {}
    count = lambda: {s.stageId(): s.shuffleWriteRecords() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList()))}
    before = count()
    found = run().agg(F.count("*")).first()[0]
    return found, sum(n for stage, n in count().items() if stage not in before)


def test_prefixes_find_what_tiles_find(spark):
    """The two ways give the same rows, and no row of the prefix join is copied to blocks: its shuffles grow like the records."""
    from linkloom.plans import registry

    got = {}
    for sf in ("0.001", "0.01"):
        queries, s1 = registry._prepared(spark, f"/root/testdata/sf{sf}")
        left, right = tfidf.sparse_sides(queries, s1, ["src", "q_id"], 5000)
        rounded = lambda df: sorted((r["src"], r["q_id"], r["s1_id"], round(r["score"], 6), round(r["acos"], 6)) for r in df.collect())
        if sf == "0.001":
            by = [tfidf.similarity_join(queries, s1, ["src", "q_id"], few_tiles=n) for n in (10**6, 0)]
            assert rounded(by[0]) == rounded(by[1]) and by[0].count() > 500
            tight = [tfidf.similarity_join(queries, s1, ["src", "q_id"], k=2, address_k=1, max_df=30, few_tiles=n) for n in (10**6, 0)]
            assert rounded(tight[0]) == rounded(tight[1])
        got[sf] = _shuffled(spark, lambda left=left, right=right: tfidf._by_prefixes(left, right, ["src", "q_id"], 12, 6, 0.05, 0.4))[1]
    assert 0 < got["0.01"] < got["0.001"] * 10**1.2


def test_report_sends_no_row_to_all_blocks(spark, monkeypatch):
    """Many small blocks report what one does, and the shuffles grow like the records, not like blocks times records."""
    from linkloom.plans import registry

    got, rows = {}, {}
    for sf in ("0.001", "0.01"):
        queries, s1 = registry._prepared(spark, f"/root/testdata/sf{sf}")
        queries, s1 = (registry.spool(df, "prepared") for df in (queries, s1))
        rounded = lambda df: sorted((r["q_id"], r["n_pairs"], round(r["best_score"], 6), round(r["best_acos"], 6), round(r["total_ncos"], 4)) for r in df.collect())
        if sf == "0.001":
            rows["one"] = rounded(tfidf.cosine_report(queries, s1, ["q_id"]))
        for name, n in (("QUERY_TERMS", 1500), ("SHARD_TERMS", 1500), ("PULLED", 5000)):
            monkeypatch.setattr(tfidf, name, n, raising=False)
        if sf == "0.001":
            rows["many"] = rounded(tfidf.cosine_report(queries, s1, ["q_id"]))
        got[sf] = _shuffled(spark, lambda: tfidf.cosine_report(queries, s1, ["q_id"]))  # noqa: B023
    assert rows["one"] == rows["many"] and len(rows["one"]) > 100
    assert 0 < got["0.01"][1] < got["0.001"][1] * 10**1.2


def test_blocks_end_where_their_terms_have_many_postings(spark, monkeypatch):
    """Queries with the same terms share a block; one that alone has too many postings gets a block of its own."""
    rows = [(i, [1, 2], [6, 2]) for i in range(5)] + [(5, [3, 4], [5, 1]), (6, [5], [90]), (7, [6], [3])]
    queries = spark.createDataFrame(rows, "row long, common array<long>, df array<long>").withColumns({"n_terms": F.col("common"), "a_terms": F.array().cast("array<long>")})
    monkeypatch.setattr(tfidf, "PULLED", 14)
    block = {r["row"]: r["block"] for r in tfidf.blocked(queries).collect()}
    assert [[q for q in sorted(block) if block[q] == b] for b in sorted(set(block.values()))] == [[0, 1, 2, 3, 4, 5], [6], [7]]
    monkeypatch.setattr(tfidf, "PULLED", 8)
    block = {r["row"]: r["block"] for r in tfidf.blocked(queries).collect()}
    assert [[q for q in sorted(block) if block[q] == b] for b in sorted(set(block.values()))] == [[0, 1, 2, 3, 4], [5], [6], [7]]


def test_forms_split_each_text_once(spark):
    """Name, other name and address are split into words once each, beside one Arrow node, whose answer is taken only for what isn't ASCII."""
    rows = [("S1-1", "Étoile dba Straße Corp", "Große Allee 5, Île-de-France", "FR"), ("S1-2", "Hot Ring dba Øl", "5 Large Street, Suite 7", "US"), ("S1-3", None, None, "US")]
    found = prepared(spark.createDataFrame(rows, SCHEMA))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("['’‘`´]") == 3
    got = [(r["n_core"], r["n_alt"], r["a_norm"], r["a_state"]) for r in found.orderBy("entity_id").collect()]
    assert got == [("etoile strasse", "strasse", "grosse allee 5", "fr_idf"), ("hot ring ol", "ol", "5 large st ste 7", ""), ("", "", "", "")]


def test_prefix_of_a_query(spark):
    """Impacts 0.5, 0.3, 0.1 of names and 0.4 of an address: what may be left out follows from the floors."""
    rows = [(1, "n", 11, 0.8, 0.625), (1, "n", 12, 0.5, 0.6), (1, "n", 13, 0.33, 0.303), (1, "a", 14, 1.0, 0.4)]
    terms_of = spark.createDataFrame(rows, "q long, channel string, term long, w double, top double")
    kept = lambda floor, floor_a: {r["term"]: (round(r["rest_n"], 3), round(r["rest_a"], 3)) for r in tfidf.prefixes(terms_of, spark.createDataFrame([(1, floor, floor_a)], "q long, floor double, floor_a double")).collect()}
    assert set(kept(0.04, 0.05)) == {11, 12, 13, 14} and set(kept(0.06, 0.9)) == {11, 12, 14}
    assert kept(0.6, 0.9) == {11: (0.4, 0.4)} and kept(0.6, 0.3) == {11: (0.4, 0.0), 14: (0.4, 0.0)} and kept(0.9, 0.9) == {}


def test_bounds_leave_few_pairs_to_score(spark, monkeypatch):
    """The bound is never below the score, the best are those of scoring every pair, and under a third of all pairs are scored."""
    from linkloom.plans import entities

    s1, s2, s3 = entities.sources(spark, "/root/testdata/sf0.01")
    left, right = flows._numbered(s1), flows._numbered(s2.unionByName(s3))
    cands = spool_of(blocking.fast_candidates(blocking.fast_keys(left), blocking.fast_keys(right)))
    both = pairs.with_sides(cands, left, right, list(dict.fromkeys([*pairs.CODES, *pairs.SIGNS])))
    assert both.where(pairs.cheap_bound() < pairs.cheap_score() - 1e-9).count() == 0 and both.where(pairs.cheap_bound() > pairs.cheap_score() + 1e-9).count() > 0
    scored, with_sides = [], pairs.with_sides
    monkeypatch.setattr(pairs, "with_sides", lambda some, l, r, columns, keep=None: scored.append(some.count() if "word_codes" in columns else 0) or with_sides(some, l, r, columns, keep))
    k = 5
    best = {(r["_s1"], r["_cand"], r["cheap"]) for r in flows.cheap_best(cands, left, right, k).collect()}
    monkeypatch.undo()
    every = pairs.with_sides(cands, left, right, ["id", *pairs.CODES]).select(F.col("s1_id"), F.col("l_id").alias("_s1"), F.col("r_id").alias("_cand"), F.round(pairs.cheap_score(), 9).alias("cheap"))
    assert best == {(r["_s1"], r["_cand"], r["cheap"]) for r in selection.top_k(every, k, ["s1_id"], "cheap", ["_cand"]).collect()}
    assert 0 < sum(scored) < cands.count() / 3


def spool_of(df):
    from linkloom.sources.shared import spool

    return spool(df, "test")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_move_once_and_in_arrays(spark):
    """Postings travel as arrays; pairs are made, merged and ranked where all of a record's meet."""
    keys = lambda tag, n: spark.range(n).selectExpr(f"concat('{tag}', id) entity_id", "'name_exact' blocker", "concat('k', id % 5) key")
    ranked = blocking.capped(blocking.met(keys("S1-", 9), keys("S2-", 30), ["name_exact"], 20, 3), 4)
    assert ranked.count() == 9 * 4
    import re

    moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_of(ranked))
    assert sum("s1_id" in m for m in moved) == 1 and not any("cand_id" in m for m in moved)


def test_native_features_make_no_sets_of_pairs(spark):
    """Sets are made once for each record; a pair only looks up the left's in the right's texts. Odd texts give what sets give."""
    texts = ["", "a", "ab", "abc", "abcabc abc", "ab abc b", "a  b", " x ", "été 12 12 123456", "12 s12 1 123456", "12345 été", "aa aaa aaaa"]
    side = lambda tag: spark.createDataFrame([(f"{tag}{i}", t, t, t, "US") for i, t in enumerate(texts)], "entity_id string, business_name string, name_stripped string, addr_norm string, country_norm string")
    both = spark.createDataFrame([(f"l{i}", f"r{j}") for i in range(len(texts)) for j in range(len(texts))], "s1_id string, cand_id string")
    columns = ["business_name", "name_stripped", "addr_norm", "country_norm"]
    own = pairs.native_features(pairs.compared_sides(both, side("l"), side("r"), columns))
    late = pairs.native_features(pairs.with_sides(both, side("l"), side("r"), columns))
    assert own.columns == late.columns
    assert "array_union" not in plan_of(own) and "array_intersect" not in plan_of(own)
    from linkloom.functions import similarity as sim
    from linkloom.functions.text import words_of

    c = F.col
    ln, rn = c("l_name_stripped"), c("r_name_stripped")
    sets = {
        "name_token_jaccard": sim.jaccard(words_of(ln), words_of(rn)), "name_token_containment": sim.containment(words_of(ln), words_of(rn)), "name_char_3gram": sim.ngram_jaccard(ln, rn),
        "addr_char_3gram": sim.ngram_jaccard(ln, rn), "addr_num_overlap": sim.number_overlap(ln, rn), "addr_shared_nums": sim.number_matches(ln, rn).cast("double"),
        "postal_code_match": F.arrays_overlap(F.regexp_extract_all(ln, F.lit(r"\b[0-9]{5,6}\b"), F.lit(0)), F.regexp_extract_all(rn, F.lit(r"\b[0-9]{5,6}\b"), F.lit(0))).cast("double"),
    }
    wanted = pairs.with_sides(both, side("l"), side("r"), columns).select("s1_id", "cand_id", *(v.alias(n) for n, v in sets.items()))
    rows_of = lambda df: sorted(tuple(r) for r in df.select("s1_id", "cand_id", *sets).collect())
    assert rows_of(own) == rows_of(wanted) == rows_of(late)


def test_scored_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks that rank pairs get so many rows each at any size; the session's number of partitions stays as it is."""
    import re

    from linkloom.plans import entities

    d = "/root/testdata/sf0.001"
    n = entities.table(spark, d, "lineitem").count()
    monkeypatch.setattr(entities, "PAIR_ROWS", n // 12)
    parts = entities.pair_parts(spark, d)
    assert parts in (12, 13)
    scored = entities.scored_pairs(spark, d)
    plans = plan_of(pairs.competition(scored, parts)), plan_of(siblings.sibling_pairs(scored.withColumnRenamed("p", "p1"), parts=parts))
    assert all({int(k) for k in re.findall(r"hashpartitioning\(.*?, (\d+)\)", p)} == {parts} for p in plans)


def test_seeds_hold_to_their_postings(spark):
    """The term that would go beyond SEED_POSTINGS is no seed, unless it is the rarest."""
    rows = [(1, "n", 10, 0.5, 2), (1, "a", 11, 0.5, 100), (1, "n", 12, 0.5, 900), (2, "n", 12, 1.0, 900)]
    terms = spark.createDataFrame(rows, "q long, channel string, term long, w double, df long")
    assert sorted((r["q"], r["term"]) for r in tfidf.seed_terms(terms).collect()) == [(1, 10), (1, 11), (2, 12)]
    lists = tfidf.postings(spark.createDataFrame([(7, [1], [0.5], [2], [0.5])], "row long, n_terms array<long>, n_w array<double>, a_terms array<long>, a_w array<double>"))
    assert sorted((r["term"], r["df"], r["rows"], r["weights"]) for r in lists.collect()) == [(1, 1, [7], [0.5]), (2, 1, [7], [0.5])]


def _block_keys(spark, seed=3):
    """Keys of sources and targets: crowded, long and short ones, records with none, and targets met by a long and a short key."""
    import random

    rng = random.Random(seed)
    kinds = {"common": ("name_exact", 2), "group": ("name_token", 4), "other": ("name_ngram", 3), "few": ("composite_key", 12)}
    own = lambda tag, n: [(f"{tag}{i}", blocker, f"{kind}#{rng.randrange(many)}") for i in range(n) for kind, (blocker, many) in kinds.items() if rng.random() < 0.7]
    frame = lambda rows: spark.createDataFrame(rows, "entity_id string, blocker string, key string")
    return frame(own("S1-", 40)), frame(own("S2-", 60)), ["composite_key", "name_exact", "name_ngram", "name_token"]


def test_blocks_are_the_pairs(spark, monkeypatch):
    """Pairs of classes and of a record's own, capped or not, are those of single records; so are their lists, counts and what they hold."""
    monkeypatch.setattr(blocking, "SOURCE_ROWS", 3)
    left, right, names = _block_keys(spark)
    rows = lambda df: sorted(map(tuple, df.select("s1_id", "cand_id", "bits").collect()))
    for most, few in ((None, 8), (5, 8), (13, 4), (5, 0), (20, 100)):
        monkeypatch.setattr(blocking, "FEW", few)
        pairs_of_records = blocking.met(left, right, names, 25, 2)
        expected = rows(pairs_of_records if most is None else blocking.capped(pairs_of_records, most))
        blocks = blocking.blocks_of(left, right, names, 25, most, 3)
        assert rows(blocks.pairs()) == expected and expected
        lists: dict = {}
        for s, c, _ in expected:
            lists.setdefault(s, []).append(c)
        got = {r["s1_id"]: r["candidates"] for r in blocks.lists().collect()}
        assert {s: c for s, c in got.items() if c} == lists
        assert {r["s1_id"]: r["n"] for r in blocks.counts().collect() if r["n"]} == {s: len(c) for s, c in lists.items()}
        asked = spark.createDataFrame([(f"S1-{i}", f"S2-{j}") for i in range(45) for j in range(0, 65, 3)], "s1_id string, cand_id string")
        held = {(r["s1_id"], r["cand_id"]) for r in blocks.holding(asked).collect()}
        assert held == {(s, c) for s, c, _ in expected if int(c[3:]) % 3 == 0}


def test_pairs_of_a_class_move_nowhere(spark):
    """Records with the same long lists meet their candidates as a class: what moves are records and a class's list, not pairs or lists to each record."""
    left = spark.createDataFrame([(f"S1-{i}", "name_exact", "k") for i in range(200)] + [(f"S1-{i}", "composite_key", f"own{i}") for i in range(200)], "entity_id string, blocker string, key string")
    right = spark.createDataFrame([(f"S2-{i}", "name_exact", "k") for i in range(40)] + [(f"S2-{i}", "composite_key", f"own{i}") for i in range(40)], "entity_id string, blocker string, key string")
    blocks = blocking.blocks_of(left, right, ["composite_key", "name_exact"], 50, 30, 2)
    assert blocks.shared.count() == 30 and blocks.members.count() == 200
    import re

    moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan_of(blocks.met()))
    assert all("class" in m for m in moved) and not any("cand_id" in m or "s1_id" in m for m in moved)
    assert blocks.pairs().count() == 200 * 30
    from linkloom.operators import evaluation

    truth = spark.createDataFrame([(f"S1-{i}", [f"S2-{i}"] if i < 60 else []) for i in range(201)], "s1_id string, ids array<string>")
    lists = blocks.pairs().groupBy("s1_id").agg(F.collect_list("cand_id").alias("ids"))
    assert evaluation.evaluate_blocks(truth, blocks, 40).collect() == evaluation.evaluate_blocking(truth, lists, 40).collect()


def test_lists_never_pass_the_driver(spark, monkeypatch):
    """What grows with the input is merged, not sent: Spark takes written lists for much smaller than they are. Only crowded keys and classes may go to all."""
    plans, spool = [], blocking.spool
    monkeypatch.setattr(blocking, "spool", lambda df, name, *more: plans.append(plan_of(df)) or spool(df, name, *more))
    s1 = records(spark, [*S1, ("S1-003", "", "", ""), ("S1-003", "", "", "")])
    lists = blocking.generate_candidates(s1, records(spark, S2), records(spark, S3))
    blocks = blocking.rule_blocks(s1, spool_of(records(spark, S2 + S3)), most=2)
    asked = spark.createDataFrame([("S1-001", "S2-001")], "s1_id string, cand_id string")
    made = [lists, blocks.met(), blocks.lists(), blocks.holding(asked)]
    sent = [line for plan in [*plans, *map(plan_of, made)] for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert sent and all("LeftAnti" in line or "[longs" in line for line in sent), sent
    # Rows without any candidate stay, each once.
    got = [(r["s1_id"], r["candidates"]) for r in lists.collect()]
    assert sorted(s for s, _ in got) == ["S1-001", "S1-002", "S1-003", "S1-003"] and [c for s, c in got if s == "S1-003"] == [[], []]


def test_two_stages_send_no_records_to_all(spark, monkeypatch):
    """Terms, lists and pairs of both stages are merged, as the written records they come from look much smaller than they are. Only crowded terms and countries' sizes may go to all."""
    plans, spool = [], tfidf.spool
    for module in (tfidf, flows):
        monkeypatch.setattr(module, "spool", lambda df, name, *more: plans.append(plan_of(df)) or spool(df, name, *more))
    queries, parents = _tfidf_sides(spark, 40)
    queries, parents = spool_of(queries), spool_of(parents)
    found = tfidf.similarity_join(queries, parents, ["src", "q_id"])
    by_prefix = tfidf.similarity_join(queries, parents, ["src", "q_id"], few_tiles=0)
    cands = spool_of(found.withColumn("p1", F.col("score")))
    pairs_found = [tfidf.pair_cosines(cands.select("src", "q_id", "s1_id"), queries, parents, ["src", "q_id"]), flows.featured(cands.select("src", "q_id", "s1_id", "ncos", "acos"), queries, parents)]
    pairs_found += [siblings.expand(cands, queries), siblings.sibling_features(cands, queries)]
    every = "\n".join([*plans, *map(plan_of, [found, by_prefix, *pairs_found])])
    sent = [line for line in every.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    small = lambda line: "LeftAnti" in line and "term" in line or line.split("BroadcastHashJoin ")[-1].startswith("[country#") and line.count("[") == 2 and "term" not in line
    assert all(map(small, sent)), [line for line in sent if not small(line)]
