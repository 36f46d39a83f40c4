"""op7 and op8: rules, canonical URLs, the filter, and revisits."""

import pytest
from pyspark.sql import functions as F

from linkloom.llm import urlfilter, warc

URLS = [
    None, "", "no scheme", "http://net/", "http://a.NET/x", "http://net", "http://a.net?x", "http://example.net/en/1", "https://b.example.net/en", "http://example.com/de/", "http://xexample.com/de/", "http://a.org/fr/x", "http://a.org/de/x",
    "http://u@a.net:80/x", "http://WWW.Shop.example.org:443/a//?utm_source=x&b=2&a=1#f", "http://shop.example.org/a?a=1&b=2", "x://y://z/", "http://é.org/fr/",
]


def expected_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in urlfilter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=len, default=None)


def test_rules_and_list(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)] + [(3, URLS[3], 1)], "page_id long, url string, block int")
    out = urlfilter.judge(pages, urlfilter.listed_urls(pages)).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        host, path, rule = expected_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        verdict = dict(urlfilter.RULES).get(rule) or ("block" if r["page_id"] in (14, 15) else "allow")
        assert (r["verdict"], r["listed"]) == (verdict, rule is None and r["page_id"] in (14, 15)), r
    none = pages.limit(0)
    assert urlfilter.judge(none, urlfilter.listed_urls(none)).count() == 0
    assert urlfilter.judge(pages, urlfilter.listed_urls(none)).where("listed").count() == 0


@pytest.mark.parametrize("sent", [urlfilter.MAX_SENT, 1])
def test_filter_has_no_false_negative(spark, monkeypatch, sent):
    monkeypatch.setattr(urlfilter, "MAX_SENT", sent)  # blocks beyond it are joined by shuffle
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://h', id % 50, '.example.org/p/', id % 3000) AS url")
    listed = pages.where("page_id % 3 = 0").select(urlfilter.canonical(pages.url).alias("canonical_url")).distinct()
    exact = {r[0] for r in listed.collect()}
    table, blocks = urlfilter.build_filter(listed)
    assert table.count() <= blocks == 32
    out = urlfilter.judge(pages, listed).join(pages, "page_id").select("listed", urlfilter.canonical(F.col("url")).alias("c")).collect()
    assert len(out) == 4000 and all(r["listed"] == (r["c"] in exact) for r in out)


def test_one_url_on_most_rows(spark):
    hot, other = "http://hot.org/a?utm_source=x", "http://cold.org/b"
    pages = spark.range(3000).selectExpr("id AS page_id", f"if(id % 3 = 0, '{other}', '{hot}') AS url")
    got = urlfilter.judge(pages, urlfilter.listed_urls(pages)).groupBy("host", "verdict").count().collect()
    assert sorted(map(tuple, got)) == [("cold.org", "allow", 1000), ("hot.org", "block", 2000)]


def test_sql(spark, oracle_rows):
    from linkloom.llm import queries

    for name in queries.ORACLES:
        found, wanted = oracle_rows(queries.QUERIES[name], queries.ORACLES[name])
        assert found == wanted, name


RECORDS = "record_id string, url string, ts long, kind string, etag string, last_modified long, headers map<string,string>, found string"


def test_revisits(spark):
    h = {"Content-Type": "text/html", "ETag": '"1"', "Cache-Control": "a"}
    rows = [
        ("r1", "http://x.org/a", 100, "response", '"1"', 5, h, ""), ("r2", "http://www.x.org/a/#z", 200, "response", '"2"', 6, {"ETag": '"2"', "Server": "s"}, ""), ("r3", "http://x.org/a", 200, "response", '"3"', 7, {"ETag": '"3"'}, ""),
        ("v1", "http://x.org/a", 150, "revisit", 'W/"1"', None, {"etag": 'W/"1"', "content-length": "0", "Cache-Control": "b"}, ""), ("v2", "http://x.org/a#q", 200, "revisit", '"1"', None, None, ""), ("v3", "http://x.org/a", 200_000_000, "revisit", '"9"', None, None, ""),
        ("v4", "http://x.org/a", 300, "revisit", None, 7, None, ""), ("v5", "http://x.org/a", 300, "revisit", None, None, {"vary": "x"}, ""), ("v6", "http://x.org/a", 100, "revisit", '"1"', None, None, ""), ("v7", None, 300, "revisit", '"1"', None, None, ""),
        ("v8", "http://x.org/a", None, "revisit", '"1"', None, None, ""), ("v9", "http://other.org/", 300, "revisit", '"1"', None, None, ""), ("v1", "http://x.org/a", 150, "revisit", 'W/"1"', None, {"etag": 'W/"1"'}, ""), ("m", "http://x.org/a", 1, "metadata", None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    for width in (50, 86_400):
        got = [(r["record_id"], r["response_id"], r["outcome"], r["headers"]) for r in warc.resolve(df, width).collect()]
        assert sorted(got, key=str) == sorted([
            ("v1", "r1", "resolved", 'cache-control: b; content-type: text/html; etag: W/"1"'), ("v1", "r1", "resolved", 'cache-control: a; content-type: text/html; etag: W/"1"'), ("v2", "r1", "resolved", 'cache-control: a; content-type: text/html; etag: "1"'),
            ("v3", "r3", "validator_mismatch", None), ("v4", "r3", "resolved", 'etag: "3"'), ("v5", "r3", "unchecked", 'etag: "3"; vary: x'), ("v6", None, "no_response", None), ("v7", None, "no_response", None), ("v8", None, "no_response", None), ("v9", None, "no_response", None),
        ], key=str)
    assert warc.resolve(df.limit(0)).count() == 0


def test_headers_of_one_name(spark):
    """Names that differ in case alone, and null values, are no crash."""
    stored = {"ETag": '"a"', "etag": '"b"', "Server": None, "X": "1", "x": "2"}
    rows = [("r", "http://x.org/", 1, "response", '"a"', None, stored, ""), ("v", "http://x.org/", 2, "revisit", '"a"', None, {"DATE": "d1", "Date": "d2", "vary": None}, "")]
    out = warc.resolve(spark.createDataFrame(rows, RECORDS)).first()
    assert out["headers"] == 'date: d1; etag: "a"; server: ; vary: ; x: 1'


def test_a_hot_url_resolves_as_a_loop_does(spark):
    import random

    rng = random.Random(6)
    rows = [(f"{k[0]}{i}", f"http://h.org/{rng.choice('aaab')}", rng.randrange(400), k, f'"{rng.randrange(2)}"', None, {"x": "y"}, "") for i in range(300) for k in [rng.choice(["response", "revisit"])]]
    for r in warc.resolve(spark.createDataFrame(rows, RECORDS), 37).collect():
        own = next(x for x in rows if x[0] == r["record_id"])
        before = [x for x in rows if x[3] == "response" and x[1] == own[1] and x[2] < own[2]]
        best = max(before, key=lambda x: (x[2], x[0]), default=None)
        assert r["response_id"] == (best and best[0])
        assert r["outcome"] == ("no_response" if best is None else "resolved" if best[4] == own[4] else "validator_mismatch")
