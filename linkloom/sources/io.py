"""Reading and writing the tables of record linkage: entity records, id lists, encoded bundles, page fetches."""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from linkloom.sources.shared import shared_dir

RECORD_COLUMNS = ["entity_id", "business_name", "business_address", "country"]
TRUTH_COLUMNS = ["source1_entity_id", "matched_entity_ids"]
MATCH_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]


def text_schema(columns: Iterable[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_tsv(spark: SparkSession, paths: str | list[str], columns: list[str], place: bool = False) -> DataFrame:
    """Tab-separated text with a header in any order and case; quotes doubled; fields trimmed, '' for what is missing.

    Blank rows are skipped. A missing required column raises ValueError. With ``place`` the columns _file and _row give
    the rows' order: by the files' paths, then as they stand there.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "PERMISSIVE"}
    head = spark.read.options(**options).csv(paths[0]).columns
    known = {h.strip().lower(): i for i, h in enumerate(head)}
    missing = [c for c in columns if c not in known]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df = spark.read.options(**options).schema(text_schema(f"_c{i}" for i in range(len(head)))).option("enforceSchema", True).csv(paths)
    order = [F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")] if place else []
    df = df.select(*(F.trim(F.coalesce(F.col(f"_c{known[c]}"), F.lit(""))).alias(c) for c in columns), *order)
    return df.where(F.concat(*map(F.col, columns)) != "")


def read_records(spark: SparkSession, paths: str | list[str], max_rows: int | None = None) -> DataFrame:
    """Entity records of one or several files; with max_rows only the first rows in their order."""
    if max_rows is None:
        return read_tsv(spark, paths, RECORD_COLUMNS)
    return read_tsv(spark, paths, RECORD_COLUMNS, place=True).orderBy("_file", "_row").limit(max_rows).drop("_file", "_row")


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(source, n): lines of each source's files but their headers."""
    out = None
    for name, path in paths.items():
        per = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("lines"))
        one = per.agg(F.coalesce(F.sum(F.col("lines") - 1), F.lit(0)).alias("n")).select(F.lit(name).alias("source"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def write_strings(records: DataFrame, path: str) -> None:
    """Lower-cased names and addresses by entity_id, beside the prepared records."""
    records.select("entity_id", F.lower("business_name").alias("name"), F.lower("business_address").alias("address")).write.mode("overwrite").parquet(path)


def strings_of(rows: DataFrame, store: DataFrame, key: str, prefix: str) -> DataFrame:
    """rows with the store's name and address of the entity in ``key``, under names with a prefix."""
    return rows.join(store.select(F.col("entity_id").alias(key), F.col("name").alias(f"{prefix}name"), F.col("address").alias(f"{prefix}address")), key, "left")


def source_of(entity_id) -> F.Column:
    return F.when(entity_id.startswith("S1-"), "S1").when(entity_id.startswith("S2-"), "S2").when(entity_id.startswith("S3-"), "S3").otherwise("UNKNOWN")


def keyed(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def parse_id_list(text) -> F.Column:
    """Distinct trimmed ids of a comma list."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, ids) of a file of id lists; of repeated parents the last in the file's order counts."""
    df = read_tsv(spark, path, TRUTH_COLUMNS).select(F.col("source1_entity_id").alias("s1_id"), parse_id_list(F.col("matched_entity_ids")).alias("ids"), F.monotonically_increasing_id().alias("_row"))
    return keyed(df, "s1_id", ["_row"]).drop("_row")


def truth_pairs(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.explode("ids").alias("cand_id"))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows whose key ``ids`` has."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def prepared_scan(spark: SparkSession, path: str, columns: list[str] | None = None, country: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """A prepared Parquet table with its columns and rows pruned by the scan; country and ids exclude each other."""
    if country is not None and ids is not None:
        raise ValueError("filter by country or by ids, not both")
    df = spark.read.parquet(path)
    if country is not None:
        df = df.where(F.col("country") == country)
    if ids is not None:
        df = by_ids(df, ids)
    return df.select(*columns) if columns else df


def countries(df: DataFrame) -> DataFrame:
    return df.select("country").distinct().orderBy("country")


def read_id_column(spark: SparkSession, path: str) -> DataFrame:
    """Distinct values of a file's first column."""
    df = spark.read.options(sep="\t", header=True, quote="").csv(path)
    return df.select(F.trim(F.col(df.columns[0])).alias("entity_id")).where("entity_id <> ''").distinct()


def read_json_map(spark: SparkSession, path: str) -> dict:
    """A small JSON object, through Spark's own reader."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


# Sinks.


def id_lists(pairs: DataFrame, required: DataFrame, header: list[str]) -> DataFrame:
    """One row for each required s1_id: its ids trimmed, distinct, sorted, comma-joined; '' for none."""
    own = pairs.select("s1_id", F.trim("cand_id").alias("cand_id")).where("cand_id <> ''").groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("_list"))
    df = required.select("s1_id").distinct().join(own, "s1_id", "left")
    return df.select(F.col("s1_id").alias(header[0]), F.coalesce("_list", F.lit("")).alias(header[1]))


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated with a header and without quotes, sorted by the first column; one file only where asked for."""
    out = df.orderBy(df.columns[0])
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", lineSep="\n").csv(path)


def write_prepared(df: DataFrame, path: str) -> None:
    """By country, so that scans of one country prune the rest."""
    df.write.mode("overwrite").partitionBy("country").parquet(path)


def _table_of(path: str) -> str:
    return f"linkloom_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, columns: list[str], buckets: int) -> None:
    """A table in so many buckets of the columns' hash, one sorted file each; its layout stands beside it, so that any session can open it."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_table_of(path)}")
    df.repartition(buckets, *columns).write.mode("overwrite").format("parquet").bucketBy(buckets, *columns).sortBy(*columns).option("path", path).saveAsTable(_table_of(path))
    layout = {"schema": df.schema.json(), "columns": columns, "buckets": buckets}
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table with its buckets: joins and groupings by its columns need no exchange of it, and one key is one file."""
    layout, name = read_json_map(spark, f"{path}.layout"), _table_of(path)
    if not spark.catalog.tableExists(name):
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(layout["schema"])))
        by = ", ".join(f"`{c}`" for c in layout["columns"])
        spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    return spark.table(name)


@dataclass(frozen=True)
class Bundle:
    """Encoded targets: keys (class, key, entity_id) without the crowded ones, and what is compared of each entity_id."""

    keys: DataFrame
    payload: DataFrame


BUNDLE_ROWS = 500_000  # of the payload in a bucket


def write_bundle(keys: DataFrame, payload: DataFrame, path: str, key: str = "entity_id", buckets: int | None = None) -> None:
    """The encoded targets, to be built once and read often, each table in buckets of what it is joined by. The mark is written last."""
    buckets = buckets or max(8, -(-payload.count() // BUNDLE_ROWS))
    write_bucketed(keys, f"{path}/keys", ["class", "key"], buckets)
    write_bucketed(payload, f"{path}/payload", [key], buckets)
    fs, at = _files(keys.sparkSession, f"{path}/_complete")
    fs.create(at).close()


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def has_bundle(spark: SparkSession, path: str) -> bool:
    """Whether a bundle was written there to its end."""
    fs, at = _files(spark, f"{path}/_complete")
    return fs.exists(at)


def read_bundle(spark: SparkSession, path: str, entity: str | None = None, key: str = "entity_id") -> Bundle:
    """Keys and payload; of one entity only its bucket of the payload is read."""
    payload = read_bucketed(spark, f"{path}/payload")
    return Bundle(read_bucketed(spark, f"{path}/keys"), payload if entity is None else payload.where(F.col(key) == F.lit(entity)))


def write_resumable(rows: DataFrame, path: str, key: str, buckets: int = 16, make: Callable[[DataFrame], DataFrame] | None = None, at_once: int | None = None) -> list[int]:
    """Writes what ``make`` gives of the rows (by default the rows), by hash buckets of the key; returns the buckets written.

    Only buckets that aren't there yet are made, so a run that goes on after another broke off computes what is missing and
    nothing else. at_once: how many buckets' rows go into one call of make (default: all that are missing); what is done when
    a run breaks off is done for good. make must return the key, and of a row only what belongs to that row's key.

    A bucket counts as written once its mark is: a mark is written after its bucket, which is overwritten on the next try until then.
    A plan of make runs once: it is written by bucket first, and each bucket's files are read from there.
    """
    spark = rows.sparkSession
    fs, _ = _files(spark, path)
    marks = {b: _files(spark, f"{path}/_marks/{b}")[1] for b in range(buckets)}
    missing = [b for b, mark in marks.items() if not fs.exists(mark)]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    for at in range(0, len(missing), at_once or max(1, len(missing))):
        wave = missing[at : at + (at_once or len(missing))]
        own = rows.where(bucket.isin(wave))
        made = (make(own) if make else own).withColumn("_bucket", bucket)
        staged = f"{shared_dir(spark).rstrip('/')}/resumable-{uuid.uuid4().hex}"
        made.write.partitionBy("_bucket").parquet(staged)
        held = spark.read.schema(made.schema).parquet(staged)
        for b in wave:
            held.where(F.col("_bucket") == b).drop("_bucket").write.mode("overwrite").parquet(f"{path}/bucket={b}")
            fs.create(marks[b]).close()
        fs.delete(_files(spark, staged)[1], True)
    return missing


# Fetching pages.

Fetcher = Callable[[str, float], dict]
FETCHED = "url string, final_url string, status_code int, content_type string, html string, response_time_ms double, redirect_chain array<string>, error string"


def http_fetch(url: str, timeout: float) -> dict:
    """One page by the standard library, through all redirects, over http and https alone; errors come back as text.

    Certificates aren't verified, as what is analysed may well have a bad one. Without a scheme it is http.
    """
    import ssl
    import urllib.error
    import urllib.request

    chain: list[str] = []

    class Follow(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, request, page, code, message, headers, new):
            chain.append(request.full_url)
            if not new.lower().startswith(("http://", "https://")):
                raise ValueError(f"redirect to {new}")
            return super().redirect_request(request, page, code, message, headers, new)

    got = {"final_url": url, "status_code": None, "content_type": None, "html": None, "redirect_chain": chain, "error": None}
    scheme = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*(?=:)", url.strip())
    if scheme and scheme[0].lower() not in ("http", "https"):
        return got | {"error": f"Unsupported scheme: {scheme[0].lower()}"}
    try:
        any_certificate = ssl.create_default_context()
        any_certificate.check_hostname, any_certificate.verify_mode = False, ssl.CERT_NONE
        opener = urllib.request.build_opener(Follow, urllib.request.HTTPSHandler(context=any_certificate))
        with opener.open(urllib.request.Request(url.strip() if scheme else f"http://{url.strip()}", headers={"User-Agent": "linkloom/1.0"}), timeout=timeout) as page:
            got |= {"final_url": page.geturl(), "status_code": page.status, "content_type": page.headers.get_content_type()}
            return got | {"html": page.read().decode(page.headers.get_content_charset() or "utf-8", "replace")}
    except urllib.error.HTTPError as e:
        return got | {"final_url": e.geturl() or url, "status_code": e.code, "error": str(e)}
    except TimeoutError:
        return got | {"error": f"Timeout after {timeout}s"}
    except (OSError, ValueError, LookupError) as e:
        slow = isinstance(getattr(e, "reason", None), TimeoutError)
        return got | {"error": f"Timeout after {timeout}s" if slow else f"Connection error: {e}"}


def fetch_pages(urls: DataFrame, fetch: Fetcher = http_fetch, timeout: float = 5.0, at_once: int = 16) -> DataFrame:
    """One row for each url with what the fetcher brings, in each task so many at once. A fetcher of the caller's own takes (url, timeout)."""

    def timed(url: str) -> dict:
        begin = time.perf_counter()
        return {"url": url} | fetch(url, timeout) | {"response_time_ms": round((time.perf_counter() - begin) * 1000, 2)}

    def run(frames):
        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                yield pd.DataFrame(list(pool.map(timed, frame["url"])), columns=[part.split()[0] for part in FETCHED.split(", ")])

    return urls.select("url").mapInPandas(run, FETCHED)
