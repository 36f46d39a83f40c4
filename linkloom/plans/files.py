"""Queries of sources and sinks: tables are written to the shared folder and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import blocking
from linkloom.plans import entities, flows, sql
from linkloom.plans.entities import SOURCES_SQL, TRUTH_SQL, table
from linkloom.plans.registry import _cheap_sql, _fast_keys_sql, _fast_sql, _normalized, joined, query
from linkloom.sources import io
from linkloom.sources.shared import shared_dir, spool
from linkloom.streaming import index, urls

_RECORD = "entity_id, business_name, business_address, country"


def _at(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(spark, d, single_file: bool = False) -> dict[str, str]:
    """The three sources as tab-separated files."""
    paths = {}
    for name, df in zip(("s1", "s2", "s3"), entities.sources(spark, d), strict=True):
        paths[name] = _at(spark, name)
        io.write_tsv(df.select(*_RECORD.split(", ")), paths[name], single_file)
    return paths


@query(f"WITH {SOURCES_SQL} SELECT {_RECORD} FROM records")
def tsv_records(spark, d):
    """All records by way of their files."""
    return io.read_records(spark, list(_written(spark, d).values()))


@query(f"WITH {SOURCES_SQL} SELECT {_RECORD} FROM s1 ORDER BY entity_id LIMIT 100")
def tsv_first_records(spark, d):
    """The first rows of a file, which stand there by entity_id."""
    return io.read_records(spark, _written(spark, d, single_file=True)["s1"], 100)


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def keyed_records(spark, d):
    """The last order of each customer."""
    return io.keyed(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def _truth_file(spark, d) -> str:
    truth, path = entities.truth(spark, d), _at(spark, "truth")
    io.write_tsv(io.id_lists(io.truth_pairs(truth), truth.select("s1_id"), io.MATCH_HEADER), path)
    return path


@query(f"WITH {TRUTH_SQL} SELECT s1_id, array_to_string(list_sort(ids), ',') AS ids FROM truth")
def truth_file(spark, d):
    return io.read_truth(spark, _truth_file(spark, d)).select("s1_id", *joined("ids"))


@query(f"WITH {TRUTH_SQL} SELECT s1_id AS entity_id FROM truth")
def id_column(spark, d):
    return io.read_id_column(spark, _truth_file(spark, d))


@query(f"WITH {SOURCES_SQL}, {TRUTH_SQL} SELECT {_RECORD} FROM records WHERE entity_id IN (SELECT cand_id FROM truth_pairs WHERE cand_id LIKE 'S3-%')")
def records_by_ids(spark, d):
    wanted = io.truth_pairs(entities.truth(spark, d)).where("cand_id LIKE 'S3-%'").select(F.col("cand_id").alias("entity_id"))
    return io.by_ids(io.read_records(spark, list(_written(spark, d).values())), wanted)


@query(f"WITH {SOURCES_SQL} SELECT 's1' AS source, (SELECT count(*) FROM s1) AS n UNION ALL SELECT 's2', (SELECT count(*) FROM s2) UNION ALL SELECT 's3', (SELECT count(*) FROM s3)")
def row_counts(spark, d):
    return io.row_counts(spark, _written(spark, d))


def _prepared_at(spark, d) -> str:
    path = _at(spark, "prepared")
    io.write_prepared(_normalized(spark, d).drop("country").withColumnRenamed("country_norm", "country"), path)
    return path


@query(f"WITH {SOURCES_SQL},{sql.normalized('records')} SELECT entity_id, name_norm, addr_norm FROM norm WHERE country_norm = 'INDIA'")
def prepared_scan(spark, d):
    """Two columns of one country, which the scan prunes."""
    return io.prepared_scan(spark, _prepared_at(spark, d), ["entity_id", "name_norm", "addr_norm"], country="INDIA")


@query(f"WITH {SOURCES_SQL},{sql.normalized('records')} SELECT DISTINCT country_norm AS country FROM norm")
def prepared_countries(spark, d):
    return io.countries(io.prepared_scan(spark, _prepared_at(spark, d)))


@query(f"""WITH {SOURCES_SQL}, {TRUTH_SQL} SELECT t.s1_id, t.cand_id, lower(l.business_name) AS l_name, lower(l.business_address) AS l_address, lower(r.business_name) AS r_name, lower(r.business_address) AS r_address
FROM truth_pairs t JOIN records l ON l.entity_id = t.s1_id JOIN records r ON r.entity_id = t.cand_id""")
def pair_strings(spark, d):
    """Raw strings of both sides of every true pair, from the store beside the records."""
    path = _at(spark, "strings")
    io.write_strings(entities.all_records(spark, d), path)
    store = spark.read.parquet(path)
    return io.strings_of(io.strings_of(io.truth_pairs(entities.truth(spark, d)), store, "s1_id", "l_"), store, "cand_id", "r_")


@query(f"""WITH {SOURCES_SQL},{_fast_sql()},{_fast_keys_sql()} SELECT class, count(*) AS n_keys, count(DISTINCT k.entity_id) AS n_entities, CAST(sum(length(fast_name)) AS BIGINT) AS name_chars
FROM fkeys k JOIN fast f ON f.entity_id = k.entity_id WHERE k.entity_id NOT LIKE 'S1-%' GROUP BY class""")
def encoded_bundle(spark, d):
    """Keys and payload of the targets, written and read as a bundle."""
    _, s2, s3 = entities.sources(spark, d)
    targets, path = text.fast_records(s2.unionByName(s3)), _at(spark, "bundle")
    io.write_bundle(blocking.fast_keys(targets), text.encoded_records(targets).select("entity_id", "name_len"), path)
    held = io.read_bundle(spark, path)
    return held.keys.join(held.payload, "entity_id").groupBy("class").agg(F.count("*").alias("n_keys"), F.countDistinct("entity_id").alias("n_entities"), F.sum("name_len").alias("name_chars"))


@query(f"WITH {SOURCES_SQL},{_fast_sql()},{_fast_keys_sql()},{_cheap_sql()} SELECT s1_id, cand_id, round(cheap, 6) AS cheap FROM cheap")
def bundle_topk(spark, d):
    """The fast flow's best candidates from a bundle of the targets, written once and joined where it lies."""
    s1, s2, s3 = entities.sources(spark, d)
    path = _at(spark, "targets")
    flows.write_targets(s2.unionByName(s3), path)
    return flows.fast_pairs(s1, io.read_bundle(spark, path)).select("s1_id", "cand_id", F.round("cheap", 6).alias("cheap"))


class _BrokenOff(Exception):
    pass


@query(f"WITH {TRUTH_SQL} SELECT s1_id, array_to_string(list_sort(ids), ',') AS ids FROM truth")
def resumable_lists(spark, d):
    """Id lists by buckets: a run breaks off after a third of them, the next makes the others, a third nothing."""
    path, calls = _at(spark, "resumable"), []
    lists = entities.truth(spark, d)

    def make(part: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 3:
            raise _BrokenOff
        return part.select("s1_id", F.array_join(F.array_sort("ids"), ",").alias("ids"))

    try:
        io.write_resumable(lists, path, "s1_id", 6, make, at_once=1)
    except _BrokenOff:
        pass
    for _ in range(2):
        io.write_resumable(lists, path, "s1_id", 6, make, at_once=2)
    return spark.read.parquet(path).select("s1_id", "ids")


@query(f"WITH {SOURCES_SQL},{sql.candidates()} SELECT s1_id, cand_id, array_to_string(reasons, ',') AS reasons FROM cands")
def streamed_candidates(spark, d):
    """Targets arrive in files and are indexed, by one stream and by its restart; then records arrive and meet the index."""
    s1, s2, s3 = entities.sources(spark, d)
    arriving, path, seen = _at(spark, "arriving"), _at(spark, "index"), _at(spark, "seen")
    for more in (s2, s3):
        more.select(*_RECORD.split(", ")).repartition(2).write.mode("append").parquet(arriving)
        stream = urls.read_stream(spark, arriving, io.text_schema(_RECORD.split(", ")), per_batch=1)
        index.write_index(stream, path, f"{path}-at").awaitTermination()
    s1.select(*_RECORD.split(", ")).repartition(2).write.parquet(seen)
    records = urls.read_stream(spark, seen, io.text_schema(_RECORD.split(", ")), per_batch=1)
    met = _at(spark, "met")
    lists = spool(index.posting_lists(index.read_index(spark, path)), "lists")
    urls.write_stream(urls.arriving_lists(records, lists), met, f"{met}-at").awaitTermination()
    found = index.with_reasons(spark.read.parquet(met), blocking.source_parts(spark.read.parquet(seen)))
    return found.select("s1_id", "cand_id", *joined("reasons"))


@query("SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def json_map(spark, d):
    """Customers by region, through a side input of one JSON object that says each nation's."""
    path = _at(spark, "map")
    names = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "r_name")))
    names.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.text(path)
    regions = F.create_map(*(F.lit(x) for pair in sorted(io.read_json_map(spark, path).items()) for x in pair))
    return table(spark, d, "customer").groupBy(F.try_element_at(regions, F.col("c_nationkey").cast("string")).alias("region")).agg(F.count("*").alias("customers"))


@query(f"WITH {SOURCES_SQL},{sql.normalized('records')} SELECT entity_id, 'first_word' AS blocker, concat('first#', ({sql.words('name_norm')})[1]) AS key FROM norm WHERE len({sql.words('name_norm')}) > 0")
def custom_blocker(spark, d):
    """Keys of a strategy of the caller's own."""
    first = lambda: blocking.only(F.col("name_norm") != "", blocking.tagged("first", F.element_at(text.words_of(F.col("name_norm")), 1)))
    return blocking.blocking_keys(_normalized(spark, d), {"first_word": first})
