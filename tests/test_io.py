"""Sources and sinks, and streams over them."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions.text import normalized_records
from linkloom.operators import blocking
from linkloom.sources import io
from linkloom.streaming import urls


def test_records(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('Business_Name\tENTITY_ID\tcountry\tbusiness_address\n"Say ""hi"", Ltd"\tS1-1\t US \t1, Main\n\n\t\t\t\nShort\tS1-2\n', encoding="utf-8")
    got = {r["entity_id"]: tuple(r) for r in io.read_records(spark, str(tmp_path / "a.tsv")).collect()}
    assert got == {"S1-1": ("S1-1", 'Say "hi", Ltd', "1, Main", "US"), "S1-2": ("S1-2", "Short", "", "")}
    assert io.read_records(spark, str(tmp_path / "a.tsv"), 1).count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        io.read_tsv(spark, str(tmp_path / "a.tsv"), ["nope"])
    kinds = spark.createDataFrame([("S1-1",), ("S9-1",)], "i string").select(io.source_of(F.col("i"))).collect()
    assert [k[0] for k in kinds] == ["S1", "UNKNOWN"]


def test_truth_and_lists(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-2,,S2-1\nS1-2\t\nS1-1\tS2-9\n")
    assert {r["s1_id"]: r["ids"] for r in io.read_truth(spark, str(tmp_path / "t.tsv")).collect()} == {"S1-1": ["S2-9"], "S1-2": []}
    assert {r[0] for r in io.read_id_column(spark, str(tmp_path / "t.tsv")).collect()} == {"S1-1", "S1-2"}
    pairs = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", " S2-5"), ("S1-1", "S2-5")], "s1_id string, cand_id string")
    required = spark.createDataFrame([("S1-2",), ("S1-1",)], "s1_id string")
    io.write_tsv(io.id_lists(pairs, required, io.MATCH_HEADER), str(tmp_path / "out"), single_file=True)
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-5,S3-1\nS1-2\t\n"


def test_prepared_scan_prunes(spark, tmp_path):
    df = spark.createDataFrame([("a", "US", 1), ("b", "IN", 2)], "entity_id string, country string, x int")
    io.write_prepared(df, str(tmp_path / "p"))
    scan = io.prepared_scan(spark, str(tmp_path / "p"), ["entity_id"], country="US")
    assert [r[0] for r in scan.collect()] == ["a"] and "PartitionFilters: [isnotnull(country" in scan._jdf.queryExecution().toString()
    assert [r[0] for r in io.countries(io.prepared_scan(spark, str(tmp_path / "p"))).collect()] == ["IN", "US"]
    with pytest.raises(ValueError, match="not both"):
        io.prepared_scan(spark, str(tmp_path / "p"), country="US", ids=df)
    assert io.keyed(df.unionByName(df.withColumn("x", F.lit(9))), "entity_id", ["x"]).agg(F.min("x")).first()[0] == 9


def test_resumable_writes(spark, tmp_path):
    df = spark.range(200).selectExpr("id", "concat('k', id) AS key")
    path = str(tmp_path / "r")
    assert io.write_resumable(df, path, "key", 4) == [0, 1, 2, 3]
    (tmp_path / "r/_marks/2").unlink()  # as if the run had ended before bucket 2 was done
    assert io.write_resumable(df, path, "key", 4) == [2]
    assert spark.read.parquet(*(f"{path}/bucket={b}" for b in range(4))).count() == 200


def test_bundle_and_fetch(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "entity_id string, x int")
    keys = spark.createDataFrame([("c", "k", "a")], "class string, key string, entity_id string")
    assert not io.has_bundle(spark, str(tmp_path / "b"))
    io.write_bundle(keys, df, str(tmp_path / "b"))
    held = io.read_bundle(spark, str(tmp_path / "b"))
    assert io.has_bundle(spark, str(tmp_path / "b")) and (held.keys.count(), held.payload.count()) == (1, 1)

    def fake(url, timeout):
        return {"final_url": url, "status_code": 200 if "ok" in url else None, "content_type": "text/html", "html": "<title>x</title>", "redirect_chain": [], "error": None if "ok" in url else "Timeout"}

    one = io.read_bundle(spark, str(tmp_path / "b"), entity="a").payload
    assert [tuple(r) for r in one.collect()] == [("a", 1)] and io.read_bundle(spark, str(tmp_path / "b"), entity="z").payload.count() == 0
    got = {r["url"]: (r["status_code"], r["error"]) for r in io.fetch_pages(spark.createDataFrame([("http://ok",), ("http://no",)], "url string"), fake).collect()}
    assert got == {"http://ok": (200, None), "http://no": (None, "Timeout")}


def test_fetching_follows_redirects(spark):
    """Over a server of our own: two hops, an error, and a page that takes too long."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow":
                time.sleep(2)
            self.send_response({"/a": 302, "/b": 301, "/none": 404}.get(self.path, 200))
            if self.path in ("/a", "/b"):
                self.send_header("Location", "/b" if self.path == "/a" else "/c")
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write("<title>é</title>".encode("latin-1"))

        def log_message(self, *_):
            pass

    listening = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=listening.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{listening.server_port}"
    try:
        urls_ = spark.createDataFrame([(f"{at}/{p}",) for p in ("a", "c", "none", "slow")] + [("http://127.0.0.1:1/",), ("file:///etc/hostname",)], "url string")
        got = {r["url"].removeprefix(at): r for r in io.fetch_pages(urls_, timeout=1.0).collect()}
    finally:
        listening.shutdown()
    assert got["/a"]["final_url"] == f"{at}/c" and got["/a"]["redirect_chain"] == [f"{at}/a", f"{at}/b"] and got["/a"]["html"] == "<title>é</title>"
    assert got["/c"]["redirect_chain"] == [] and got["/none"]["status_code"] == 404
    assert "Timeout" in got["/slow"]["error"] and "Connection error" in got["http://127.0.0.1:1/"]["error"] and got["file:///etc/hostname"]["error"] == "Unsupported scheme: file" and got["file:///etc/hostname"]["html"] is None


def test_streams_equal_batch_and_resume(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    batch = spark.createDataFrame([(i, f"http://h{i}.example.com/login") for i in range(6)], "page_id long, url string")
    batch.limit(3).write.parquet(str(source))
    run = lambda: urls.write_stream(urls.analyzed_urls(urls.read_stream(spark, str(source), batch.schema)), str(sink), str(tmp_path / "ckpt")).awaitTermination()
    run()
    assert spark.read.parquet(str(sink)).count() == 3
    batch.subtract(batch.limit(3)).write.mode("append").parquet(str(source))
    run()
    got = spark.read.parquet(str(sink))
    assert got.count() == 6 and got.schema.fieldNames() == urls.analyzed_urls(batch).schema.fieldNames()
    assert got.exceptAll(urls.analyzed_urls(batch)).count() == 0


def test_arriving_records_meet_standing_keys(spark, tmp_path):
    schema = "entity_id string, business_name string, business_address string, country string"
    target = spark.createDataFrame([("S2-1", "Blue Star Ltd", "12 Park Lane", "US")], schema)
    keys = blocking.pruned_keys(blocking.blocking_keys(normalized_records(target)))
    spark.createDataFrame([("S1-1", "Blue Star", "12 Park Lane", "US"), ("S1-2", "Zed", "1 Q", "FR")], schema).write.parquet(str(tmp_path / "in"))
    stream = urls.arriving_candidates(urls.read_stream(spark, str(tmp_path / "in"), target.schema), keys)
    urls.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert {(r["s1_id"], r["cand_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("S1-1", "S2-1")}


def test_a_resumed_run_makes_only_what_is_missing(spark, tmp_path):
    """The first run breaks off after a third of its buckets; rows are counted as they are made."""
    df, path = spark.range(600).selectExpr("id", "concat('k', id % 300) AS key"), str(tmp_path / "r")
    made = []

    def make(part):
        if len(made) == 2 and not broken:
            broken.append(1)
            raise RuntimeError("lost")
        made.append(part.count())
        return part.groupBy("key").agg(F.count("*").alias("n"))

    broken: list = []
    with pytest.raises(RuntimeError, match="lost"):
        io.write_resumable(df, path, "key", 6, make, at_once=1)
    first = sum(made)
    assert len(made) == 2 and 0 < first < 400
    assert io.write_resumable(df, path, "key", 6, make, at_once=3) == [2, 3, 4, 5]
    assert sum(made) == 600 and len(made) == 4  # every row was made once over both runs
    assert io.write_resumable(df, path, "key", 6, make) == [] and len(made) == 4
    got = spark.read.parquet(path).select("key", "n").collect()
    assert len(got) == 300 and {r["n"] for r in got} == {2}


def test_bundle_is_joined_where_it_lies(spark, tmp_path):
    """The same pairs with and without a bundle, and no exchange of either of its tables, in any session that opens it."""
    from linkloom.plans import entities, flows

    s1, s2, s3 = entities.sources(spark, "/root/testdata/sf0.001")
    targets, path = s2.unionByName(s3), str(tmp_path / "bundle")
    flows.write_targets(targets, path, buckets=4)
    rows = lambda df: sorted(tuple(r) for r in df.select("s1_id", "cand_id", "cheap", "combined").collect())
    plain = rows(flows.fast_pairs(s1, targets))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it is made, before any stage has run
    try:
        for part in ("keys", "payload"):
            spark.sql(f"DROP TABLE {io._table_of(f'{path}/{part}')}")  # as a new session would find it
        held = flows.fast_pairs(s1, io.read_bundle(spark, path))
        plan = held._jdf.queryExecution().executedPlan()
        exchanges, todo = [], [plan]
        while todo:
            node = todo.pop()
            if "Exchange" in node.nodeName():
                exchanges.append(node.toString())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        bundled = [e for e in exchanges if "Bucketed: true" in e]
        # What lies over the bundle's own scan without a join between is the bundle alone.
        assert exchanges and "Bucketed: true" in plan.toString() and not [e for e in bundled if "Join" not in e]
        assert plain == rows(held) and len(plain) > 100
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_submission_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    """Lists of a run that broke off and went on are those of an unbroken one, and the second run compares the missing S1 alone."""
    from linkloom.operators import models
    from linkloom.plans import entities, flows

    s1, s2, s3 = entities.sources(spark, "/root/testdata/sf0.001")
    compared, flow = [], flows.fast_flow

    class Name(models.Matcher):
        def score(self, pairs):
            return pairs.withColumn("score", F.col("combined"))

    def counted(part, *rest):
        if len(compared) == 1 and not broken:
            broken.append(1)
            raise RuntimeError("lost")
        compared.append(part.count())
        return flow(part, *rest)

    broken: list = []
    monkeypatch.setattr(flows, "fast_flow", counted)
    run = lambda name: flows.submit(s1, s2.unionByName(s3), Name(), str(tmp_path / name), bundle=str(tmp_path / "targets"), buckets=3, at_once=1)
    with pytest.raises(RuntimeError, match="lost"):
        run("out")
    assert run("out") == [1, 2] and sum(compared) == s1.count() and run("out") == []
    broken.append(1)
    assert run("whole") == [0, 1, 2]
    lists = lambda name: sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / name / "buckets")).select("s1_id", "matched_entity_ids", "candidate_entity_ids").collect())
    assert lists("out") == lists("whole") and len(lists("out")) == s1.count() and any(m for _, m, _ in lists("out"))


def test_index_grows_over_files_and_restarts(spark, tmp_path):
    """A key is closed by the posting beyond the cap, in one batch or over several, and stays closed; the log is written once."""
    from linkloom.operators import blocking
    from linkloom.functions.text import normalized_records
    from linkloom.streaming import index

    blockers = {"name_exact": blocking.exact_name, "name_compact": blocking.compact_name}
    names = ["Hot Name"] * 5 + ["Warm Name"] * 3 + ["Cold Name"]
    rows = [(f"S2-{i}", n, "1 Street", "US") for i, n in enumerate(names)]
    schema, folder, path = io.text_schema(io.RECORD_COLUMNS), str(tmp_path / "in"), str(tmp_path / "index")
    seen = []
    for part in (rows[:2] + rows[5:7], rows[2:5], rows[7:] + [("S2-9", "Hot Name", "2 Street", "US")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        index.write_index(urls.read_stream(spark, folder, schema, per_batch=1), path, str(tmp_path / "at"), 3, blockers).awaitTermination()
        seen.append(sorted(tuple(r) for r in index.read_index(spark, path).collect()))
    every = spark.createDataFrame(rows + [("S2-9", "Hot Name", "2 Street", "US")], schema)
    batch = blocking.pruned_keys(blocking.blocking_keys(normalized_records(every), blockers), 3).select("key", "entity_id", "blocker")
    assert seen[2] == sorted(tuple(r) for r in batch.collect()) and {"exact_name#hot name"} & {k for k, *_ in seen[0]} and not {k for k, *_ in seen[1] if "hot" in k}
    assert spark.read.parquet(path).where("closed").groupBy("key").count().where("count > 1").count() == 0


def test_index_counts_without_python(spark, tmp_path):
    """Keys are counted by Spark alone, however many there are; a key that a batch alone crowds leaves one row in the log."""
    from linkloom.operators import blocking
    from linkloom.streaming import index

    schema, folder, path = io.text_schema(io.RECORD_COLUMNS), str(tmp_path / "in"), str(tmp_path / "index")
    rows = spark.createDataFrame([(f"S2-{i}", "Hot Name" if i < 9 else f"Cold {i}", "1 Street", "US") for i in range(12)], schema)
    rows.coalesce(1).write.parquet(folder)
    blockers = {"name_exact": blocking.exact_name}
    plan = index.indexed(rows, 3, blockers)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    index.write_index(urls.read_stream(spark, folder, schema), path, str(tmp_path / "at"), 3, blockers).awaitTermination()
    log = spark.read.parquet(path)
    assert log.where("key = 'exact_name#hot name'").count() == log.where("closed").count() == 1
    assert {r["entity_id"] for r in index.read_index(spark, path).collect()} == {"S2-9", "S2-10", "S2-11"}
