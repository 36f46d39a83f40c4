"""Similarity joins on TF-IDF terms, per country.

Terms are a long table; the records of the first source give document frequencies per country, and queries
keep only their terms. Each record becomes one row with its terms' numbers and weights.

``similarity_join`` finds each query's best, beyond a few tiles by prefix filtering. A query's rarest terms seed it: their postings name
records, the likeliest of which are compared exactly, and what they score is a floor under the query's own k-th best.
Of its terms, those with the most impact first, only a prefix can then lead to another record that reaches the floor: what
the rest could add is bounded by their weights and by the largest weight a record has for each. The prefix's postings
name the candidates, sums over it and the bound for the rest drop most, and the others are compared exactly. A query meets
only postings of its terms, a record only the queries that name it; no term has more than max_df postings.

``cosine_report`` counts all pairs that share a term, so its work is all of them. Queries that share their commonest
terms come into one block, which gets the postings of its terms, each once, and multiplies them in Arrow. A block ends
where its terms have so many postings, so a posting moves as often as blocks ask for its term and no row is copied
to all blocks. ``tiles``, in which every block of queries meets every shard of records, are left to ``similarity_join``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from linkloom.functions.text import char_ngrams, words_of
from linkloom.functions.translit import skeleton
from linkloom.operators.selection import top_k
from linkloom.sources.shared import spool, unsent


def _bigrams(words: Column, tag: str) -> Column:
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit(tag), F.element_at(words, i), F.lit("_"), F.element_at(words, i + 1)))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def _tag(tag: str, words: Column) -> Column:
    return F.transform(words, lambda t: F.concat(F.lit(tag), t))


def name_terms() -> Column:
    core, compact, domain = words_of(F.col("n_core")), F.col("n_compact"), F.col("n_domain")
    some = lambda when, *terms: F.when(when, F.array(*terms)).otherwise(F.array().cast("array<string>"))
    grams = F.when(F.length(compact) >= 4, _tag("g", char_ngrams(F.concat(F.lit("^"), compact, F.lit("$")), 4))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(
        _tag("n", core), _tag("s", words_of(F.col("n_skel"))), _bigrams(core, "b"), some(F.length(compact) >= 4, F.concat(F.lit("c"), compact)), some(F.length(domain) >= 3, F.concat(F.lit("c"), domain)),
        _tag("n", words_of(F.col("n_alt"))), _tag("#", F.filter(words_of(F.col("n_norm")), lambda t: t.rlike("^[0-9]+$"))), grams,
    ))


def address_terms() -> Column:
    words = words_of(F.col("a_norm"))
    postal = F.when(F.col("a_postal") != "", F.array(F.concat(F.lit("z"), "a_postal"))).otherwise(F.array().cast("array<string>"))
    long = F.filter(words_of(F.col("a_words")), lambda t: F.length(t) >= 4)
    return F.array_distinct(F.concat(_tag("a", words), _bigrams(words, "p"), postal, _tag("k", F.transform(long, skeleton))))


def terms(records: DataFrame, ids: list[str], country: str = "country") -> DataFrame:
    """(ids, country, channel, term) of prepared records; channel is n (name) or a (address)."""
    both = F.concat(F.transform(name_terms(), lambda t: F.struct(F.lit("n").alias("channel"), t.alias("term"))), F.transform(address_terms(), lambda t: F.struct(F.lit("a").alias("channel"), t.alias("term"))))
    return records.select(*ids, F.col(country).alias("country"), F.explode(both).alias("t")).select(*ids, "country", "t.channel", "t.term")


def idf_table(s1_terms: DataFrame, s1: DataFrame, max_df: int = 5000, country: str = "country") -> DataFrame:
    """(country, channel, term, df, idf) of the terms that at most max_df records of a country have."""
    return with_idf(s1_terms.groupBy("country", "channel", "term").agg(F.count("*").alias("df")).where(F.col("df") <= max_df), s1, country)


def with_idf(counted: DataFrame, s1: DataFrame, country: str = "country") -> DataFrame:
    """Terms of countries and how many records have them (df), with idf."""
    sizes = s1.groupBy(F.col(country).alias("country")).agg(F.count("*").alias("n"))
    return counted.join(sizes, "country").select("country", "channel", "term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted(term_rows: DataFrame, idf: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, country, channel, term, w): idf over the record's norm, among the terms that idf has."""
    met = term_rows.join(unsent(idf), ["country", "channel", "term"])
    norms = met.groupBy(*ids, "country", "channel").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return met.join(unsent(norms), [*ids, "country", "channel"]).select(*ids, "country", "channel", "term", (F.col("idf") / F.col("norm")).alias("w"))


def sparse(term_rows: DataFrame, idf: DataFrame, ids: list[str], common: bool = False) -> DataFrame:
    """One row for each record: ids, country, and per channel the numbers of its terms, ascending, and their weights (n_terms, n_w, a_terms, a_w).

    common: also its terms, the commonest first, with the number of records that have each (common, df).
    """
    met = term_rows.join(unsent(idf), ["country", "channel", "term"])
    rows = met.groupBy(*ids, "country").agg(F.array_sort(F.collect_list(F.struct("channel", "number", "idf", "df"))).alias("own"))
    columns = [c for channel in ("n", "a") for c in _weights(channel)]
    if common:
        rows = rows.withColumn("_by", F.sort_array(F.transform("own", lambda t: F.struct(t["df"].alias("df"), t["number"].alias("number"))), asc=False))
        columns += [F.col("_by.number").alias("common"), F.col("_by.df").alias("df")]
    return rows.select(*ids, "country", *columns)


def _weights(channel: str) -> list[Column]:
    own = F.filter("own", lambda t: t["channel"] == channel)
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda acc, t: acc + t["idf"] * t["idf"]))
    return [F.transform(own, lambda t: t["number"]).alias(f"{channel}_terms"), F.transform(own, lambda t: t["idf"] / norm).alias(f"{channel}_w")]


def sparse_sides(queries: DataFrame, s1: DataFrame, q_ids: list[str], max_df: int, common: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sparse rows of queries (with common) and of s1 (s1_id), written once; terms have the numbers of the written idf table.

    The crowded terms, few, go to all rows, which then move nowhere to be dropped.
    """
    key = ["country", "channel", "term"]
    s1_terms = spool(terms(s1, ["s1_id"]), "terms")
    counted = spool(s1_terms.groupBy(*key).agg(F.count("*").alias("df")), "counted")
    crowded = spool(counted.where(F.col("df") > max_df).select(*key), "crowded")
    rare = lambda rows: rows.join(crowded, key, "left_anti")
    idf = spool(with_idf(counted.where(F.col("df") <= max_df), s1).withColumn("number", F.monotonically_increasing_id()), "idf")
    row = F.monotonically_increasing_id()
    return spool(sparse(rare(terms(queries, q_ids)), idf, q_ids, common).withColumn("row", row), "sparse-queries"), spool(sparse(rare(s1_terms), idf, ["s1_id"]).withColumn("row", row), "sparse-records")


QUERY_TERMS, SHARD_TERMS = 250_000, 2_000_000  # terms of the records that meet in a tile
STRIP_ROWS, STRIP_TERMS, CELLS = 128, 4_000_000, 8_000_000  # queries multiplied at once, matching terms, and cells of a matrix


class _Channel:
    """Terms and weights of a table's rows, flat."""

    def __init__(self, table: pa.Table, channel: str):
        column = table.column(f"{channel}_terms").combine_chunks()
        self.size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.term = column.flatten().to_numpy(zero_copy_only=False)
        self.weight = table.column(f"{channel}_w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.start = np.concatenate([[0], np.cumsum(self.size)])

    def copies(self) -> np.ndarray:
        """A number for each row, the same where terms and weights are."""
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(self.term[i:j].tobytes() + self.weight[i:j].tobytes(), len(seen)) for i, j in zip(self.start[:-1], self.start[1:], strict=True)], dtype=np.int64)

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Its postings: term (ascending), row and weight."""
        order = np.argsort(self.term, kind="stable")
        return self.term[order], np.repeat(np.arange(len(self.size)), self.size)[order], self.weight[order]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all runs, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _busiest(channels: list[tuple], n: int) -> np.ndarray:
    """Of each of n queries where the postings of its commonest term begin; queries with the same stand together in a strip."""
    best, key = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for at, (q, low, size, _, _) in enumerate(channels):
        full = q.size > 0
        if not full.any():
            continue
        begin = q.start[:-1][full]
        most = np.maximum.reduceat(size, begin)
        place = np.maximum.reduceat(np.where(size == np.repeat(most, q.size[full]), low, -1), begin)
        better = most > best[full]
        row = np.flatnonzero(full)[better]
        best[row], key[row] = most[better], 2 * place[better] + at
    return key


def strips(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of left, rows of right, ncos, acos): for at most STRIP_ROWS of left's rows all of right's that share a term with any, ascending, as dense matrices."""
    return strips_of(left, {c: _Channel(right, c).held() for c in ("n", "a")}, right.num_rows)


def strips_of(left: pa.Table, postings: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], n_right: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same of the postings (term ascending, row, weight) of n_right rows for each channel.

    Every row of left is in one strip. Rows that share their commonest term are multiplied together, so that a matrix is hardly larger than its matches;
    rows whose terms of a channel are the same are multiplied once.
    """
    channels = []
    counts = np.zeros(left.num_rows, dtype=np.int64)
    for name in ("n", "a"):
        q, (held, row, weight) = _Channel(left, name), postings[name]
        low, high = np.searchsorted(held, q.term, "left"), np.searchsorted(held, q.term, "right")
        counts += np.bincount(np.repeat(np.arange(left.num_rows), q.size), weights=high - low, minlength=left.num_rows).astype(np.int64)
        channels.append((q, low, high - low, row, weight))
    copies = [q.copies() for q, *_ in channels]
    by = np.argsort(_busiest(channels, left.num_rows), kind="stable")
    ends = np.cumsum(counts[by])
    column, seen = np.zeros(n_right, dtype=np.int64), np.zeros(n_right, dtype=bool)
    at = 0
    while at < left.num_rows:
        before = ends[at - 1] if at else 0
        matches = ends[at : at + STRIP_ROWS] - before
        cells = np.arange(1, len(matches) + 1) * np.minimum(matches, n_right)
        stop = at + max(1, int(min(np.searchsorted(matches, STRIP_TERMS, "right"), np.searchsorted(cells, CELLS, "right"))))
        rows = by[at:stop]
        met = []
        for (q, low, size, row, weight), copy in zip(channels, copies, strict=True):
            _, first, own = np.unique(copy[rows], return_index=True, return_inverse=True)
            once = rows[first]
            flat = _runs(q.start[once], q.size[once])
            size = size[flat]
            place = _runs(low[flat], size)
            met.append((np.repeat(np.repeat(np.arange(len(once)), q.size[once]), size), row[place], np.repeat(q.weight[flat], size) * weight[place], len(once), own))
        for _, j, *_ in met:
            seen[j] = True
        places = np.flatnonzero(seen)
        seen[places] = False
        column[places] = np.arange(len(places))
        n = len(places)
        # Where a channel has no match, bincount's zeros are whole numbers.
        yield (rows, places, *(np.bincount(i * n + column[j], weights=w, minlength=m * n).reshape(m, n).astype(np.float64, copy=False)[own] for i, j, w, m, own in met))
        at = stop


def _blocks(rows: DataFrame, terms_each: int) -> int:
    """How many blocks of so many terms the sparse rows make."""
    total = rows.agg(F.sum(F.size("n_terms") + F.size("a_terms")).cast("long")).first()[0]
    return -(-max(1, total or 0) // terms_each)


def tiles(queries: DataFrame, records: DataFrame, q_ids: list[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """What ``run`` returns of each block of sparse queries with each shard of sparse records of the same country."""
    blocks, shards = _blocks(queries, QUERY_TERMS), _blocks(records, SHARD_TERMS)
    deal = lambda ids, m: F.pmod(F.xxhash64(*ids), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.withColumn("_block", deal(q_ids, blocks)).withColumn("_shard", every(shards))
    right = records.withColumn("_shard", deal(["s1_id"], shards)).withColumn("_block", every(blocks))
    key = ["country", "_block", "_shard"]
    empty = pa.Table.from_pylist([], schema=_arrow(schema))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right) if left.num_rows and right.num_rows else empty

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


PULLED = 2_000_000  # postings that the terms of a block have together, but for a block of one query


def blocked(queries: DataFrame) -> DataFrame:
    """Sparse queries (with common, df) and their block: neighbours by their commonest terms, of at most QUERY_TERMS terms that have PULLED postings."""

    def cut(batches):
        held, n_terms, pulled, block = set(), 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            blocks = []
            for own, df in zip(batch.column("common").to_pylist(), batch.column("df").to_pylist(), strict=True):
                more = sum(n for t, n in zip(own, df, strict=True) if t not in held)
                if held and (pulled + more > PULLED or n_terms + len(own) > QUERY_TERMS):
                    held, n_terms, pulled, block, more = set(), 0, 0, block + 1, sum(df)
                held.update(own)
                n_terms, pulled = n_terms + len(own), pulled + more
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "block"])

    near = queries.repartitionByRange(_blocks(queries, QUERY_TERMS), "common", "row").sortWithinPartitions("common", "row")
    return near.mapInArrow(cut, StructType([*queries.schema.fields, StructField("block", LongType())]))


def cosine_report(queries: DataFrame, s1: DataFrame, q_ids: list[str], max_df: int = 5000) -> DataFrame:
    """Of each query the number of records that share a term, best_score, best_acos and total_ncos over them."""
    left, right = sparse_sides(queries, s1, q_ids, max_df, common=True)
    left = spool(blocked(left), "blocks")
    pulled = left.select(F.col("block").alias("asked"), F.explode("common").alias("term")).distinct().join(postings(right), "term").select("asked", "term", "rows", "weights")
    schema = left.select(*q_ids).schema.add("n_pairs", "long").add("best_score", "double").add("best_acos", "double").add("total_ncos", "double")
    empty = pa.Table.from_pylist([], schema=_arrow(schema))

    def run(left: pa.Table, pulled: pa.Table) -> pa.Table:
        if not left.num_rows or not pulled.num_rows:
            return empty
        pulled = pulled.sort_by("term")
        lists = pulled.column("rows").combine_chunks()
        term = np.repeat(pulled.column("term").to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        known, row = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        own = (term, row, pulled.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        parts = [(rows, ((ncos > 0) | (acos > 0)).sum(axis=1), (0.5 * (ncos + acos)).max(axis=1, initial=0.0), acos.max(axis=1, initial=0.0), ncos.sum(axis=1)) for rows, _, ncos, acos in strips_of(left, {"n": own, "a": own}, len(known))]
        row, *columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table([*(left.column(c).take(pa.array(row)) for c in q_ids), *map(pa.array, columns)], names=schema.names)

    sides = [*q_ids, "block", "n_terms", "n_w", "a_terms", "a_w"]
    return left.select(*sides).groupBy("block").cogroup(pulled.groupBy("asked")).applyInArrow(run, schema).where("n_pairs > 0")


def channel_top(pairs: DataFrame, score: str, k: int, q_ids: list[str], least: float = 0.05, relative: float = 0.4) -> DataFrame:
    """The k best by one score that reach ``least`` and ``relative`` of the query's best."""
    good = top_k(pairs.where(F.col(score) >= least), k, q_ids, score, ["s1_id"])
    best = F.max(score).over(Window.partitionBy(*q_ids))
    return good.withColumn("_best", best).where(F.col(score) >= relative * F.col("_best")).drop("_best")


DIGITS = 9  # scores are rounded before they are ranked, so that the order of sums decides no tie
LEAST = 0.05


def best_places(scores: np.ndarray, k: int, least: float) -> np.ndarray:
    """A mask of each row's k largest that reach ``least``, ties by place."""
    n = scores.shape[1]
    if n <= k:
        return scores >= least
    kth = np.partition(scores, n - k, axis=1)[:, n - k, None]
    good = (scores >= least) & (scores >= kth)
    over = np.flatnonzero(good.sum(axis=1) > k)  # ties at the k-th
    part, edge = scores[over], kth[over]
    tied = part == edge
    left = k - (part > edge).sum(axis=1, keepdims=True)
    good[over] = (part > edge) & (part >= least) | tied & (np.cumsum(tied, axis=1) <= left)
    return good


SEED_POSTINGS = 128  # of a query's rarest terms so many postings, or those of the rarest alone, are looked at for its floor
SLACK = 1e-7  # over what rounding and the order of sums can change


def impacts(rows: DataFrame) -> DataFrame:
    """(row, channel, term, w) of sparse rows."""
    of = lambda c: F.transform(F.arrays_zip(F.col(f"{c}_terms").alias("t"), F.col(f"{c}_w").alias("w")), lambda x: F.struct(F.lit(c).alias("channel"), x["t"].alias("term"), x["w"].alias("w")))
    return rows.select("row", F.explode(F.concat(of("n"), of("a"))).alias("i")).select("row", "i.*")


def postings(records: DataFrame) -> DataFrame:
    """One row for each term: how many records have it, the largest weight, and who has it (rows) with which weight (weights)."""
    held = F.collect_list(F.struct("row", "w"))
    lists = impacts(records).groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("top"), held.alias("held"))
    # Flat arrays, as they are what moves to the queries: two numbers a posting and no struct.
    return lists.select("term", "df", "top", F.col("held.row").alias("rows"), F.col("held.w").alias("weights"))


def prefixes(terms_of: DataFrame, floors: DataFrame) -> DataFrame:
    """Of each query the terms that can lead to a record at its floors, and what the others can add (rest_n, rest_a).

    terms_of: (q, channel, term, w, top); floors: (q, floor, floor_a). The terms with the most impact come first.
    A rest is at most the sum of its impacts, and at most its norm, as no record's is above 1.
    """
    from_here = Window.partitionBy("q").orderBy((F.col("w") * F.col("top")).desc(), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("q")
    own = lambda channel, value, where=True: F.when((F.col("channel") == channel) & where, value).otherwise(0.0)
    impact, square = F.col("w") * F.col("top"), F.col("w") * F.col("w")
    bound = lambda channel, window, where=True: F.least(F.sum(own(channel, impact, where)).over(window), F.sqrt(F.sum(own(channel, square, where)).over(window)))
    rows = terms_of.join(unsent(floors), "q").withColumns({"to_n": bound("n", from_here), "to_a": bound("a", from_here)})
    reaches = 0.5 * (F.col("to_n") + F.col("to_a")) >= F.col("floor") - SLACK
    rows = rows.withColumn("kept", reaches | ((F.col("channel") == "a") & (F.col("to_a") >= F.col("floor_a") - SLACK)))
    rows = rows.withColumns({"rest_n": bound("n", whole, ~F.col("kept")), "rest_a": bound("a", whole, ~F.col("kept"))})
    return rows.where("kept").select("q", "channel", "term", "w", "floor", "floor_a", "rest_n", "rest_a")


def _largest(scores: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k largest scores of each group; group ascends."""
    order = np.lexsort((-scores, group))
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order], "left")
    mask = np.zeros(len(order), bool)
    mask[order[place < k]] = True
    return mask


def named(asked: DataFrame, lists: DataFrame, pick: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """(q, s) of the records that the postings of the asked terms (q, channel, term, w, more) name and ``pick`` keeps.

    The postings of a query come together and are added up in Arrow. pick gets, for each pair, q (ascending), its sums n and a,
    and the other columns of asked, which must be the same in all rows of a query; it returns a mask.
    """
    more = [c for c in asked.columns if c not in ("q", "channel", "term", "w")]
    met = asked.join(unsent(lists.select("term", "rows", "weights")), "term").select("q", (F.col("channel") == "a").alias("address"), "w", "rows", "weights", *more)
    ordered = met.repartition("q").sortWithinPartitions("q")

    def add_up(table: pa.Table) -> pa.RecordBatch:
        held = table.column("rows").combine_chunks()
        size = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
        row = held.flatten().to_numpy(zero_copy_only=False)
        weight = table.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False) * np.repeat(table.column("w").to_numpy(), size)
        address = np.repeat(table.column("address").to_numpy(zero_copy_only=False), size)
        q, first, group = np.unique(table.column("q").to_numpy(), return_index=True, return_inverse=True)
        rows, place = np.unique(row, return_inverse=True)
        keys, pair = np.unique(np.repeat(group, size) * len(rows) + place, return_inverse=True)
        own, record = np.divmod(keys, max(1, len(rows)))
        sums = {"q": own, **{c: table.column(c).to_numpy()[first][own] for c in more}}
        sums |= {c: np.bincount(pair[which], weights=weight[which], minlength=len(keys)) for c, which in (("n", ~address), ("a", address))}
        good = pick(sums)
        return pa.RecordBatch.from_arrays([pa.array(q[own[good]]), pa.array(rows[record[good]])], names=["q", "s"])

    def run(batches):
        open_rows: list = []  # of the query that the last batch broke off in
        for batch in batches:
            q = batch.column("q").to_numpy()
            if not len(q):
                continue
            cut = int(np.searchsorted(q, q[-1], "left"))
            if cut or (open_rows and open_rows[-1].column("q")[-1].as_py() != q[0]):
                yield add_up(pa.Table.from_batches([*open_rows, batch.slice(0, cut)]))
                open_rows = []
            open_rows.append(batch.slice(cut))
        if open_rows:
            yield add_up(pa.Table.from_batches(open_rows))

    return ordered.mapInArrow(run, "q long, s long")


def compared(pairs: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """(q, s, score, ncos, acos) of pairs of sparse rows, exactly, in DIGITS digits."""
    names = [f"{c}_{x}" for c in ("n", "a") for x in ("terms", "w")]
    side = lambda rows, key, tag: rows.select(F.col("row").alias(key), *(F.col(c).alias(tag + c) for c in names))
    met = pairs.join(unsent(side(records, "s", "r_")), "s").join(unsent(side(queries, "q", "l_")), "q")

    def run(batches):
        for batch in batches:
            cosines = []
            for channel in ("n", "a"):
                flat = []
                for tag in ("l_", "r_"):
                    own = batch.column(f"{tag}{channel}_terms")
                    pair = np.repeat(np.arange(batch.num_rows), pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64))
                    flat.append((pair, own.flatten().to_numpy(zero_copy_only=False), batch.column(f"{tag}{channel}_w").flatten().to_numpy(zero_copy_only=False)))
                terms, code = np.unique(np.concatenate([f[1] for f in flat]), return_inverse=True)
                keys = np.concatenate([f[0] for f in flat]) * max(1, len(terms)) + code
                n = len(flat[0][0])
                _, i, j = np.intersect1d(keys[:n], keys[n:], assume_unique=True, return_indices=True)
                cosines.append(np.bincount(flat[0][0][i], weights=flat[0][2][i] * flat[1][2][j], minlength=batch.num_rows).astype(np.float64))
            ncos, acos = cosines
            found = [np.round(0.5 * (ncos + acos), DIGITS), np.round(ncos, DIGITS), np.round(acos, DIGITS)]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("s"), *map(pa.array, found)], names=["q", "s", "score", "ncos", "acos"])

    columns = ["q", "s", *(tag + c for tag in ("l_", "r_") for c in names)]
    return met.select(*columns).mapInArrow(run, "q long, s long, score double, ncos double, acos double")


def _by_tiles(left: DataFrame, right: DataFrame, q_ids: list[str], k: int, address_k: int, least: float) -> DataFrame:
    """Each query's best of every tile it is in: for so few tiles that hardly a row is copied."""
    columns = [*q_ids, "s1_id", "score", "ncos", "acos"]
    schema = left.select(*q_ids).schema.add("s1_id", right.schema["s1_id"].dataType)
    for name in ("score", "ncos", "acos"):
        schema = schema.add(name, "double")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("s1_id")  # so that ties by place are ties by id
        row, place, found = [], [], []
        for rows, places, ncos, acos in strips(left, right):
            score, address = np.round(0.5 * (ncos + acos), DIGITS), np.round(acos, DIGITS)
            i, j = np.nonzero(best_places(score, k, least) | best_places(address, address_k, least))
            row.append(rows[i])
            place.append(places[j])
            found.append(np.stack([score[i, j], np.round(ncos[i, j], DIGITS), address[i, j]]))
        values = np.concatenate(found, axis=1)
        return pa.table([*(left.column(c).take(pa.array(np.concatenate(row))) for c in q_ids), right.column("s1_id").take(pa.array(np.concatenate(place))), *(pa.array(v) for v in values)], names=columns)

    return tiles(left, right, q_ids, run, schema)


def seed_terms(terms_of: DataFrame) -> DataFrame:
    """(q, channel, term, w) of each query's rarest terms that name at most SEED_POSTINGS records together, or of the rarest alone.

    The floor that seeds give decides which other terms are asked at all, so a term of many postings is no seed beside rarer ones.
    """
    order = Window.partitionBy("q").orderBy("df", "term")
    so_far = F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = (F.col("so_far") <= SEED_POSTINGS) | (F.col("place") == 1)
    return terms_of.withColumns({"so_far": so_far, "place": F.row_number().over(order)}).where(few).select("q", "channel", "term", "w")


def _by_prefixes(left: DataFrame, right: DataFrame, q_ids: list[str], k: int, address_k: int, least: float, relative: float) -> DataFrame:
    """The records that each query's seeds and prefix name, compared exactly, without those that can't reach its floors."""
    lists = spool(postings(right), "postings")
    terms_of = spool(impacts(left).withColumnRenamed("row", "q").join(unsent(lists.select("term", "df", "top")), "term"), "query-terms")
    seeds = seed_terms(terms_of)
    likely = lambda sums: _largest(sums["n"] + sums["a"], sums["q"], k) | _largest(sums["a"], sums["q"], address_k)
    first = spool(compared(named(seeds, lists, likely), left, right), "seeded")
    nth = lambda score, n: F.coalesce(F.get(F.sort_array(F.collect_list(score), asc=False), F.lit(n - 1)), F.lit(0.0))
    floor = lambda score, n: F.greatest(F.lit(least), relative * F.max(score), nth(score, n))
    floors = first.groupBy("q").agg(floor("score", k).alias("floor"), floor("acos", address_k).alias("floor_a"))

    def reaching(sums: dict[str, np.ndarray]) -> np.ndarray:
        address = sums["a"] + sums["rest_a"]
        return (0.5 * (sums["n"] + sums["rest_n"] + address) >= sums["floor"] - SLACK) | (address >= sums["floor_a"] - SLACK)

    others = named(prefixes(terms_of, floors), lists, reaching).join(unsent(first.select("q", "s")), ["q", "s"], "left_anti")
    pairs = first.unionByName(compared(others, left, right))
    named_pairs = pairs.join(unsent(right.select(F.col("row").alias("s"), "s1_id")), "s").join(unsent(left.select(F.col("row").alias("q"), *q_ids)), "q")
    return named_pairs.select(*q_ids, "s1_id", "score", "ncos", "acos")


FEW_TILES = 4


def similarity_join(queries: DataFrame, s1: DataFrame, q_ids: list[str], k: int = 12, address_k: int = 6, max_df: int = 5000, least: float = LEAST, relative: float = 0.4, few_tiles: int = FEW_TILES) -> DataFrame:
    """Candidates (q_ids, s1_id, score, ncos, acos): the k best by both channels and the address_k best by address.

    queries, s1: prepared records with country; s1 has s1_id. Both must reach ``least`` and ``relative`` of the query's best.
    Where all terms make at most ``few_tiles`` tiles, tiles find them; else prefix filtering, whose work has no part that
    grows with queries times records.
    """
    left, right = sparse_sides(queries, s1, q_ids, max_df)
    if _blocks(left, QUERY_TERMS) * _blocks(right, SHARD_TERMS) <= few_tiles:
        pairs = _by_tiles(left, right, q_ids, k, address_k, least)
    else:
        pairs = _by_prefixes(left, right, q_ids, k, address_k, least, relative)
    both = channel_top(pairs, "score", k, q_ids, least, relative).unionByName(channel_top(pairs, "acos", address_k, q_ids, least, relative))
    return both.dropDuplicates([*q_ids, "s1_id"]).select(*q_ids, "s1_id", "score", "ncos", "acos")


def pair_cosines(pairs: DataFrame, queries: DataFrame, s1: DataFrame, q_ids: list[str], max_df: int = 5000, sharing: bool = False, digits: int | None = DIGITS) -> DataFrame:
    """ncos, acos and score of given pairs (q_ids, s1_id), 0 where they share nothing; such pairs are left out if ``sharing``.

    digits: what the cosines are rounded to; None for those who round them themselves, as rounding twice moves halves.
    """
    s1_terms = terms(s1, ["s1_id"])
    idf = idf_table(s1_terms, s1, max_df)
    wanted = pairs.select(*q_ids, "s1_id").distinct()
    left = weighted(terms(queries, q_ids), idf, q_ids).join(unsent(wanted), q_ids)
    right = weighted(s1_terms, idf, ["s1_id"]).select("s1_id", "channel", "term", F.col("w").alias("w1"))
    dots = left.join(unsent(right), ["s1_id", "channel", "term"]).groupBy(*q_ids, "s1_id").agg(
        F.sum(F.when(F.col("channel") == "n", F.col("w") * F.col("w1")).otherwise(0.0)).alias("ncos"), F.sum(F.when(F.col("channel") == "a", F.col("w") * F.col("w1")).otherwise(0.0)).alias("acos"),
    )
    met = pairs.join(unsent(dots), [*q_ids, "s1_id"], "inner" if sharing else "left").fillna({"ncos": 0.0, "acos": 0.0}).withColumn("score", F.round(0.5 * (F.col("ncos") + F.col("acos")), DIGITS))
    return met if digits is None else met.withColumns({c: F.round(c, digits) for c in ("ncos", "acos")})
