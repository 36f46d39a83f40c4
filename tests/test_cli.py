"""The command line over small files."""

import json

from linkloom.__main__ import main

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_flow_over_files(spark, tmp_path, capsys):
    (tmp_path / "s1.tsv").write_text(HEAD + "S1-1\tAcme Corporation\t123 Main St\tUS\nS1-2\tApex Logistics Ltd\t45 Industrial Rd\tIndia\nS1-3\tLone Wolf\t7 Far Way\tFrance\n")
    (tmp_path / "s2.tsv").write_text(HEAD + "S2-1\tACME Corp\t123 Main Street\tUSA\nS2-2\tOther Company\t9 Nowhere\tUS\n")
    (tmp_path / "s3.tsv").write_text(HEAD + "S3-1\tApex Logistics Pvt Ltd\t45 Industrial Road\tIND\n")
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\tS3-1\nS1-3\t\n")
    p = lambda name: str(tmp_path / name)
    assert main(["match", p("s1.tsv"), p("s2.tsv"), p("s3.tsv"), p("out")]) == 0
    assert main(["candidates", p("s1.tsv"), p("s2.tsv"), p("s3.tsv"), p("cands")]) == 0
    assert main(["validate", p("out/matching_results"), p("s1.tsv"), "--candidates", p("cands"), "--records", p("s2.tsv"), p("s3.tsv")]) == 0
    capsys.readouterr()
    assert main(["evaluate", p("truth.tsv"), p("out/matching_results")]) == 0
    assert json.loads(capsys.readouterr().out)["f05"] == 1.0
    (tmp_path / "bad.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-9\tS1-1\n")
    assert main(["validate", p("bad.tsv"), p("s1.tsv")]) == 1
    assert "repeated_ids: 1, e.g. S1-1" in capsys.readouterr().out
    assert main(["profile", p("s1.tsv"), p("s2.tsv")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["total"] == 5
    (tmp_path / "urls.txt").write_text("http://a.com/login\nx\n")
    assert main(["urls", p("urls.txt"), p("urls")]) == 0
    assert [json.loads(r[0])["is_valid"] for r in spark.read.text(p("urls")).collect()] == [True, False]
    assert main(["urls", p("urls.txt"), p("scored"), "--model", p("model")]) == main(["urls", p("urls.txt"), p("again"), "--model", p("model")]) == 0
    scores = [[json.loads(r[0]).get("threat", {}).get("model_score") for r in spark.read.text(p(name)).collect()] for name in ("scored", "again")]
    assert scores[0] == scores[1] and scores[0][0] > 0


def test_trained_flow_over_files(spark, tmp_path, capsys):
    p = lambda name: str(tmp_path / name)
    names = ["Blue Star", "Green Field", "Red Rock", "Old Mill", "New Bridge", "High Tower", "Deep Water", "Long Road", "Cold Spring", "Warm Hearth"]
    full = [f"{a.split()[0]} {b.split()[1]}" for a in names for b in names][:40]
    (tmp_path / "s1.tsv").write_text(HEAD + "".join(f"S1-{i}\t{n} Corporation\t{i} Main Street\tUS\n" for i, n in enumerate(full)))
    (tmp_path / "s2.tsv").write_text(HEAD + "".join(f"S2-{i}\t{n.upper()} Corp\t{i} Main St\tUSA\n" for i, n in enumerate(full) if i % 2))
    (tmp_path / "s3.tsv").write_text(HEAD + "".join(f"S3-{i}\t{n}\t{i} Main St\tUSA\n" for i, n in enumerate(full) if i % 3 == 0))
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{','.join([f'S2-{i}'] * (i % 2) + [f'S3-{i}'] * (i % 3 == 0))}\n" for i in range(len(full))))
    sources = [p("s1.tsv"), p("s2.tsv"), p("s3.tsv")]
    assert main(["train", *sources, p("truth.tsv"), p("model")]) == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert 0 < told["threshold"] < 1 and told["f05"] > 0.9
    assert main(["submit", *sources, p("model"), p("out"), "--threshold", str(told["threshold"])]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["buckets_written"] == 16
    assert main(["submit", *sources, p("model"), p("out")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["buckets_written"] == 0
    assert main(["evaluate", p("truth.tsv"), p("out/matching_results")]) == 0
    assert json.loads(capsys.readouterr().out)["f05"] > 0.9
    assert main(["sweep", *sources, p("model"), p("truth.tsv")]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 19


def test_diagnosis_and_honest_evaluation(spark, tmp_path, capsys):
    """Targets of held-out records are never learned from; a pair without a common key is told."""
    p = lambda name: str(tmp_path / name)
    full = [f"{a} {b}" for a in ("Blue", "Green", "Red", "Old", "New") for b in ("Star", "Field", "Rock", "Mill", "Bridge", "Tower")]
    (tmp_path / "s1.tsv").write_text(HEAD + "".join(f"S1-{i}\t{n} Corporation\t{i} Main Street\tUS\n" for i, n in enumerate(full)))
    (tmp_path / "s2.tsv").write_text(HEAD + "".join(f"S2-{i}\t{n.upper()} Corp\t{i} Main St\tUSA\n" for i, n in enumerate(full) if i) + "S2-0\tZyx\tFar\tFR\n")
    (tmp_path / "s3.tsv").write_text(HEAD)
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\tS2-{i}\n" for i in range(len(full))))
    sources = [p("s1.tsv"), p("s2.tsv"), p("s3.tsv"), p("truth.tsv")]
    assert main(["diagnose", *sources]) == 0
    *classes, last = map(json.loads, capsys.readouterr().out.splitlines())
    assert {c["class"]: c["covered"] for c in classes}["name_exact"] == len(full) - 1 and last == {"uncovered": 1, "examples": [["S1-0", "S2-0"]]}
    assert main(["honest", *sources, "--thresholds", "0.4"]) == 0
    (row,) = map(json.loads, capsys.readouterr().out.splitlines())
    assert row["threshold"] == 0.4 and 0 < row["true_pairs"] < len(full) / 2 and row["f05"] > 0.6


def test_service(spark):
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from linkloom import service

    listening = service.server(spark, port=0)
    threading.Thread(target=listening.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{listening.server_port}"

    def post(path, body):
        try:
            with urlopen(Request(at + path, json.dumps(body).encode(), {"Content-Type": "application/json"})) as page:
                return page.status, json.loads(page.read())
        except HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        with urlopen(at + "/health") as page:
            assert json.loads(page.read())["status"] == "healthy"
        status, one = post("/analyze", {"url": "http://paypal-login-verify.xyz/account"})
        assert status == 200 and one["is_valid"] and one["threat"]["model_score"] > 0
        status, many = post("/analyze/batch", {"urls": ["https://github.com/a", "x"]})
        assert status == 200 and (many["total_requested"], many["total_successful"], many["total_failed"]) == (2, 1, 1)
        assert [r["url"] for r in many["results"]] == ["https://github.com/a", "x"]
        for path, body in (("/analyze", {"url": ""}), ("/analyze", {"url": "a" * 5000}), ("/analyze", []), ("/analyze/batch", {"urls": []}), ("/analyze/batch", {"urls": ["a.com"] * 101}), ("/analyze", {"url": "a.com", "timeout": 99})):
            assert post(path, body)[0] == 422
        assert post("/nothing", {})[0] == 404
    finally:
        listening.shutdown()
    fake = lambda url, timeout: {"final_url": url + "/x", "status_code": 200, "content_type": "text/html", "html": "<title>Hi</title>", "redirect_chain": [url], "error": None}
    got = service.Service(spark, fake).analyze({"url": "http://a.com", "fetch_metadata": True})
    assert got["metadata"]["title"] == "Hi" and got["metadata"]["final_url"] == "http://a.com/x"
