"""Resolution of WARC revisit records that say "not modified".

A revisit is matched, by canonical URL, with the latest full response strictly before it (of those at one time,
the one with the largest record_id). If the validators agree, the response's headers are merged with those that a
304 may update. The as-of join runs over moments, the distinct times of a URL: a running last value over the moments
of a slice of time (at most ``slice_seconds`` of them), and over slices what the last one leaves. So no window
grows with the records of a URL, and the revisits of one moment are dealt to parts when they get its response.

Defined results: a null or unparsable URL resolves to no response; a revisit without validators is accepted and
marked ``unchecked``; repeated records are resolved each on its own, alike; records of null time resolve to no
response and serve none; of header names that differ in case alone the one first in code point order counts; a
null header value is an empty one; no rows give no rows; other columns never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import join_split
from linkloom.llm.urlfilter import canonical

#: Header fields that a 304 response may carry to update what is stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SLICE_SECONDS = 86_400


def weak(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """Header fields with names in lower case; of names that become equal, the first in code point order stays."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]), F.coalesce(e["value"], F.lit("")))))


def merged(stored: Column, fresh: Column) -> Column:
    """Stored header fields, updated by the permitted ones of the revisit; names in lower case."""
    update = F.map_filter(lower_names(fresh), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(lower_names(stored), lambda k, _: ~F.map_contains_key(update, k))
    return F.map_concat(kept, update)


def as_text(headers: Column) -> Column:
    """Fields as ``name: value``, sorted, between semicolons."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")


def resolve(records: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row for each revisit of records (record_id, url, ts in seconds, kind ``response`` or ``revisit``, etag, last_modified, headers).

    record_id, canonical_url, ts, response_id, response_ts, outcome, headers. outcome: resolved, unchecked,
    validator_mismatch, no_response; headers are the merged ones, null unless resolved or unchecked.
    """
    is_response = F.col("kind") == "response"
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical(F.col("url")).alias("canonical_url"), "ts", "kind", "etag", "last_modified", "headers")
    known = rows.where("canonical_url IS NOT NULL AND ts IS NOT NULL").withColumn("slice", F.floor(F.col("ts") / slice_seconds))
    own = F.struct("record_id", "ts", "etag", "last_modified", "headers")
    moment = ["canonical_url", "slice", "ts"]
    latest = known.where(is_response).groupBy(*moment).agg(F.max_by(own, "record_id").alias("latest"))
    asked = known.where(~is_response).drop("kind")
    # A moment with revisits alone needs a row too, to look back from.
    moments = asked.select(*moment).distinct().join(latest, moment, "full")
    before = Window.partitionBy("canonical_url", "slice").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    seen = moments.withColumn("found", F.last("latest", ignorenulls=True).over(before))
    slices = moments.groupBy("canonical_url", "slice").agg(F.max_by("latest", F.when(F.col("latest").isNotNull(), F.col("ts"))).alias("latest"))
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("canonical_url", "slice", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
    seen = seen.join(carried, ["canonical_url", "slice"]).select(*moment, F.coalesce("found", "carried").alias("found"))
    met = join_split(asked, seen, moment, ["record_id"])
    lost = rows.where("kind = 'revisit' AND (canonical_url IS NULL OR ts IS NULL)").withColumn("found", F.lit(None).cast(met.schema["found"].dataType))
    cols = ["record_id", "canonical_url", "ts", "etag", "last_modified", "headers", "found"]
    both = met.select(*cols).unionByName(lost.select(*cols))
    found = F.col("found")
    agree = F.when(F.col("etag").isNotNull(), F.coalesce(weak(F.col("etag")) == weak(found["etag"]), F.lit(False))).when(F.col("last_modified").isNotNull(), F.coalesce(F.col("last_modified") == found["last_modified"], F.lit(False)))
    outcome = F.when(found.isNull(), "no_response").when(agree, "resolved").when(agree.isNull(), "unchecked").otherwise("validator_mismatch")
    both = both.withColumn("outcome", outcome)
    headers = F.when(F.col("outcome").isin("resolved", "unchecked"), as_text(merged(found["headers"], F.col("headers"))))
    return both.select("record_id", "canonical_url", "ts", found["record_id"].alias("response_id"), found["ts"].alias("response_ts"), "outcome", headers.alias("headers"))


EPOCH = 1_600_000_000


def capture_log(pages: DataFrame) -> DataFrame:
    """Records of a crawl that op8 makes of pages: each page a full response, then a revisit some days later whose
    validators changed for every tenth page; every thirteenth page has a revisit before its response too."""
    first = F.lit(EPOCH) + F.col("page_id") * 60
    etag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    page = pages.select("page_id", "url", first.alias("t0"), etag.alias("tag"))
    say = lambda x: x.cast("string")
    full = page.select(
        F.concat(F.lit("r"), "page_id").alias("record_id"), "url", F.col("t0").alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), (F.col("t0") - 500).alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.coalesce("tag", F.lit("-")), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Server"), F.lit("a")).alias("headers"),
    )

    def revisit(name: str, ts: Column, tag: Column) -> DataFrame:
        fields = F.create_map(F.lit("date"), say(ts), F.lit("etag"), F.coalesce(tag, F.lit("-")), F.lit("cache-control"), F.lit("max-age=1200"), F.lit("content-length"), F.lit("0"))
        return page.select(F.concat(F.lit(name), "page_id").alias("record_id"), F.concat("url", F.lit("#seen")).alias("url"), ts.alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), (F.col("t0") - 500).alias("last_modified"), fields.alias("headers"))

    later = F.col("t0") + (F.pmod("page_id", F.lit(5)) + 1) * 86_400 + 30
    changed = F.when(F.pmod("page_id", F.lit(10)) == 7, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), "tag"))
    before = revisit("b", F.col("t0") - 3600, F.col("tag")).where(F.col("record_id").rlike("^b") & (F.pmod(F.substring("record_id", 2, 20).cast("long"), F.lit(13)) == 5))
    return full.unionByName(revisit("v", later, changed)).unionByName(before)


def oracle(canonical_sql: str) -> str:
    """op8 in DuckDB's SQL; canonical_sql gives the canonical URL of ``url``."""
    return f"""
WITH p AS (SELECT page_id, url, {EPOCH} + page_id * 60 AS t0, concat('"', left(md5(html), 16), '"') AS tag FROM pages),
f AS (SELECT concat('r', page_id) AS record_id, url, t0 AS ts, tag AS etag FROM p),
v AS (
  SELECT concat('v', page_id) AS record_id, concat(url, '#seen') AS url, t0 + (page_id % 5 + 1) * 86400 + 30 AS ts, CASE WHEN page_id % 10 = 7 THEN '"changed"' ELSE concat('W/', tag) END AS etag FROM p
  UNION ALL SELECT concat('b', page_id), concat(url, '#seen'), t0 - 3600, tag FROM p WHERE page_id % 13 = 5),
fc AS (SELECT record_id, ts, etag, {canonical_sql} AS canonical_url FROM f),
vc AS (SELECT record_id, ts, etag, {canonical_sql} AS canonical_url FROM v),
m AS (
  SELECT v.*, f.record_id AS response_id, f.ts AS response_ts, f.etag AS stored, row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.record_id DESC) AS n
  FROM vc v LEFT JOIN fc f ON v.canonical_url = f.canonical_url AND f.ts < v.ts),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN regexp_replace(etag, '^W/', '') = stored THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM m WHERE n = 1)
SELECT record_id, canonical_url, ts, response_id, response_ts, outcome,
  CASE WHEN outcome = 'resolved' THEN concat('cache-control: max-age=1200; content-type: text/html; date: ', ts, '; etag: ', etag, '; server: a') END AS headers FROM o"""
