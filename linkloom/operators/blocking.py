"""Blocking keys, index pruning and candidate generation as equi-joins.

Keys are long tables (key, entity_id, blocker). Keys with many postings are pruned before anything is
joined, which bounds the pairs a key can make; the join carries ids alone. The crowded keys are written, so that
Spark knows their size: few go to all rows, which then move nowhere to be dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import char_ngrams, words_of
from linkloom.sources.shared import spool, unsent

Keys = Callable[[], Column]

ANCHOR_STOP = ["street", "road", "avenue", "drive"]
COMMON_STREET = ["street", "drive", "road", "avenue", "lane", "court", "floor", "shop", "suite", "unit"]


def tagged(tag: str, *parts: Column) -> Column:
    return F.concat_ws("#", F.lit(tag), *parts)


def only(condition: Column, key: Column) -> Column:
    """An array of the key, or none."""
    return F.when(condition, F.array(key)).otherwise(F.array().cast("array<string>"))


def named(kind: str, name: str, keys: Column) -> Column:
    """Keys with the name of what made them."""
    return F.transform(keys, lambda k: F.struct(F.lit(name).alias(kind), k.alias("key")))


def exact_name() -> Column:
    name = F.col("name_norm")
    return only(name != "", tagged("exact_name", name))


def compact_name() -> Column:
    name = F.col("name_compact")
    return only(F.length(name) >= 3, tagged("compact_name", name))


def informative_token() -> Column:
    return F.transform(F.filter("name_tokens", lambda t: F.length(t) >= 3), lambda t: tagged("token", t))


def character_ngram(n: int = 3) -> Column:
    return F.transform(F.filter(char_ngrams(F.col("name_compact"), n), lambda g: F.length(g) == n), lambda g: tagged(f"ngram{n}", g))


def address_anchor() -> Column:
    digits = lambda t: t.rlike("^[0-9]+$")
    numbers = F.slice(F.filter("addr_tokens", lambda t: digits(t) & (F.length(t) >= 2)), 1, 3)
    words = F.filter("addr_tokens", lambda t: ~digits(t) & (F.length(t) >= 4) & ~t.isin(ANCHOR_STOP))
    return F.concat(F.transform(numbers, lambda t: tagged("addr_num", t)), F.transform(words, lambda t: tagged("addr_token", t)))


def country_assisted() -> Column:
    first, country = F.try_element_at("name_tokens", F.lit(1)), F.col("country_norm")
    known = (country != "UNKNOWN") & (F.length(first) >= 3)
    return only(F.coalesce(known, F.lit(False)), tagged("country_token", country, first))


def composite_keys() -> Column:
    name, addr, country = F.col("name_norm"), F.col("addr_norm"), F.col("country_norm")
    words = words_of(name)
    first, second = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    numbers = F.regexp_extract_all(addr, F.lit(r"\b[0-9]+\b"), F.lit(0))
    n1, n2 = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(2))
    postal = F.try_element_at(F.filter(numbers, lambda n: F.length(n).isin(5, 6)), F.lit(1))
    street = F.try_element_at(F.filter(F.regexp_extract_all(addr, F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(COMMON_STREET)), F.lit(1))
    key = lambda tag, *parts: F.concat_ws("#", country, F.lit(tag), *parts)
    named = F.size(words) > 0
    return F.array_compact(F.array(
        F.when(F.length(first) >= 3, key("name_first", first)),
        F.when(named & (F.length(name) >= 4), key("name_prefix", F.substring(name, 1, 4))),
        F.when(F.length(second) >= 3, key("name_sec", second)),
        F.when(named & n1.isNotNull(), key("num_name", n1, F.substring(name, 1, 3))),
        F.when(named & postal.isNotNull(), key("zip_name", postal, F.substring(first, 1, 3))),
        F.when(F.size(numbers) >= 2, key("addr_nums", n1, n2)),
        F.when((F.size(numbers) == 1) & (F.length(n1) >= 3) & street.isNotNull(), key("addr_num_word", n1, street)),
    ))


#: Strategies by name: functions without arguments that return an array of keys over normalised records.
BLOCKERS: dict[str, Keys] = {
    "name_exact": exact_name,
    "name_compact": compact_name,
    "name_token": informative_token,
    "name_ngram": character_ngram,
    "address_anchor": address_anchor,
    "country_assisted": country_assisted,
    "composite_key": composite_keys,
}


def register_blocker(name: str, keys: Keys) -> None:
    """Adds a strategy of the caller's own."""
    BLOCKERS[name] = keys


def blocking_keys(records: DataFrame, blockers: dict[str, Keys] | None = None) -> DataFrame:
    """Distinct (entity_id, blocker, key) of normalised records."""
    each = [named("blocker", name, keys()) for name, keys in (blockers or BLOCKERS).items()]
    return records.select("entity_id", F.explode(F.array_distinct(F.concat(*each))).alias("k")).select("entity_id", "k.blocker", "k.key")


def key_postings(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("postings"))


def crowded_keys(keys: DataFrame, max_postings: int = 500) -> DataFrame:
    """The keys with more postings, counted by a partial aggregation and written."""
    return spool(key_postings(keys).where(F.col("postings") > max_postings).select("key"), "crowded")


def pruned_keys(keys: DataFrame, max_postings: int = 500) -> DataFrame:
    """Rows of keys with at most so many postings."""
    return keys.join(crowded_keys(keys, max_postings), "key", "left_anti")


def strategy_bits(names: list[str]) -> Column:
    """The strategy of a key as a bit of a long (at most 63 of them)."""
    bit = F.lit(0).cast("long")
    for i, name in enumerate(names):
        bit = F.when(F.col("blocker") == name, F.lit(1 << i).cast("long")).otherwise(bit)
    return bit


def reasons_of(names: list[str]) -> Column:
    """The names that the bits stand for."""
    return F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(names)))).alias("reasons")


SOURCE_ROWS = 2_500  # records whose pairs meet in one task


def met(source_keys: DataFrame, target_keys: DataFrame, names: list[str], max_postings: int = 500, parts: int | None = None) -> DataFrame:
    """Pairs (s1_id, cand_id, bits) that share a key which the targets don't crowd; bits are the targets' strategies.

    A key's postings travel as one array to the records that have it, and become pairs only where all of a record's meet: pairs move
    once, as ids in arrays. What then ranks or gathers a record's pairs finds them in place. Ids may be of any type.
    parts: how many tasks the records are dealt to, as arrays don't tell how many pairs they make.
    """
    crowded = crowded_keys(target_keys, max_postings)
    left = source_keys.join(crowded, "key", "left_anti").select(F.col("entity_id").alias("s1_id"), "key")
    rare = target_keys.join(crowded, "key", "left_anti").select("key", strategy_bits(names).alias("bits"), "entity_id")
    lists = rare.repartition("key").groupBy("key", "bits").agg(F.collect_list("entity_id").alias("cand_ids"))
    return pairs_of(left.join(unsent(lists), "key"), parts)


def pairs_of(lists: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs (s1_id, cand_id, bits) of what keys led each record to (s1_id, bits, cand_ids), made where all of a record's meet."""
    dealt = lists.select("s1_id", "bits", "cand_ids").repartition(*([parts] if parts else []), "s1_id")
    return dealt.select("s1_id", F.explode("cand_ids").alias("cand_id"), "bits").groupBy("s1_id", "cand_id").agg(F.bit_or("bits").alias("bits"))


def source_parts(records: DataFrame) -> int:
    return max(1, -(-records.count() // SOURCE_ROWS))


FEW = 8  # postings of a key that move to each record of their own; longer lists are shared by the records with the same of them


@dataclass(frozen=True)
class Blocks:
    """Pairs, not made yet. Records with the same long lists are a class, whose pairs are ranked once; a record has a few of its own beside.

    members: (s1_id, class, chunk, cut, own_ids, own): a record meets its class's candidates up to the place ``cut`` but own_ids, and
    its own, (cand_id, bits), which short lists led it to. shared: (class, chunks, cand_id, bits, place). A chunk is at most about
    SOURCE_ROWS members of a class; parts: how many tasks these are dealt to.
    """

    members: DataFrame
    shared: DataFrame
    parts: int

    def dealt(self) -> tuple[DataFrame, DataFrame]:
        """Members and shared candidates (with other columns that they may have got), dealt by class and chunk."""
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
        shared = self.shared.select("*", chunk).drop("chunks")
        return self.members.repartition(self.parts, "class", "chunk"), shared.repartition(self.parts, "class", "chunk")

    def met(self) -> DataFrame:
        """Members with each of the candidates they share, which moves neither pairs nor lists to single records."""
        members, shared = self.dealt()
        met = members.drop("own").join(unsent(shared), ["class", "chunk"])
        return met.where((F.col("place") <= F.col("cut")) & ~F.array_contains("own_ids", F.col("cand_id"))).drop("cut", "own_ids", "place")

    def own(self) -> DataFrame:
        """(s1_id, cand_id, bits) that short lists led to, with all that made them candidates."""
        return self.members.repartition(self.parts, "s1_id").select("s1_id", F.explode("own").alias("o")).select("s1_id", "o.cand_id", "o.bits")

    def holding(self, pairs: DataFrame) -> DataFrame:
        """Those of the given pairs (s1_id, cand_id) that are among these."""
        met = pairs.select("s1_id", "cand_id").join(unsent(self.members), "s1_id").join(unsent(self.shared.select("class", "cand_id", "place")), ["class", "cand_id"], "left")
        shared = (F.col("place") <= F.col("cut")) & ~F.array_contains("own_ids", F.col("cand_id"))
        return met.where(F.coalesce(shared, F.lit(False)) | F.exists("own", lambda o: o["cand_id"] == F.col("cand_id"))).select("s1_id", "cand_id")

    def counts(self) -> DataFrame:
        """(s1_id, n): how many candidates each member has; those that it shares are counted by their places."""
        left_out = self.members.select("s1_id", "class", "cut", F.explode("own_ids").alias("cand_id")).join(unsent(self.shared.select("class", "cand_id", "place")), ["class", "cand_id"])
        less = left_out.where(F.col("place") <= F.col("cut")).groupBy("s1_id").agg(F.count("*").alias("less"))
        most = self.shared.groupBy("class").agg(F.count("*").alias("most"))
        met = self.members.select("s1_id", "class", "cut", F.size("own").alias("own")).join(most, "class", "left").join(less, "s1_id", "left")
        none = F.lit(0).cast("long")
        return met.select("s1_id", (F.least("cut", F.coalesce("most", none)) - F.coalesce("less", none) + F.col("own")).cast("int").alias("n"))

    def lists(self) -> DataFrame:
        """(s1_id, candidates): each member's candidates, sorted."""
        members, shared = self.dealt()
        ids = shared.groupBy("class", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cand_id"))), lambda c: c["cand_id"]).alias("ids"))
        met = members.join(unsent(ids), ["class", "chunk"], "left")
        first = F.slice(F.coalesce("ids", F.array().cast(met.schema["ids"].dataType)), F.lit(1), F.col("cut"))
        both = F.concat(F.array_except(first, F.col("own_ids")), F.transform("own", lambda o: o["cand_id"]))
        return met.select("s1_id", F.array_sort(both).alias("candidates"))

    def pairs(self) -> DataFrame:
        """All pairs (s1_id, cand_id, bits), each once."""
        return self.met().select("s1_id", "cand_id", "bits").unionByName(self.own())


def blocks_of(source_keys: DataFrame, target_keys: DataFrame, names: list[str], max_postings: int = 500, most: int | None = None, parts: int = 1) -> Blocks:
    """The pairs that share a key which the targets don't crowd; ``most`` for each record, as ``capped`` takes them.

    What leads to a record's own candidates is at most FEW postings a key. The longer lists that a record has are the same for many, so
    they are joined, counted and ranked for each such class; then only the order of a class and a record's own decides the cap.
    """
    crowded = crowded_keys(target_keys, max_postings)
    rare = target_keys.join(crowded, "key", "left_anti").select("key", F.struct(F.col("entity_id").alias("cand_id"), strategy_bits(names).alias("bits")).alias("one"))
    lists = spool(rare.groupBy("key").agg(F.collect_list("one").alias("found")).withColumns({"number": F.monotonically_increasing_id(), "is_long": F.size("found") > FEW}), "lists")
    left = source_keys.join(crowded, "key", "left_anti").select(F.col("entity_id").alias("s1_id"), "key")
    led = lists.select("key", F.when(F.col("is_long"), F.col("number")).alias("long"), F.when(~F.col("is_long"), F.col("found")).alias("found"))
    one = left.join(unsent(led), "key").select("s1_id", "long", F.explode_outer("found").alias("one")).select("s1_id", "long", "one.cand_id", "one.bits").repartition(parts, "s1_id")
    mine = one.groupBy("s1_id", "cand_id", "long").agg(F.bit_or("bits").alias("bits"))
    led_to = F.collect_list(F.when(F.col("cand_id").isNotNull(), F.struct("cand_id", "bits")))
    records = spool(mine.groupBy("s1_id").agg(F.array_sort(F.collect_list("long")).alias("longs"), led_to.alias("own")), "records")
    classes = spool(records.groupBy("longs").agg(F.ceil(F.count("*") / SOURCE_ROWS).alias("chunks")).withColumn("class", F.monotonically_increasing_id()), "classes")
    listed = classes.select("class", "chunks", F.explode("longs").alias("number")).join(unsent(lists.where("is_long").select("number", "found")), "number")
    joint = listed.select("class", "chunks", F.explode("found").alias("one")).groupBy("class", "chunks", "one.cand_id").agg(F.bit_or("one.bits").alias("bits"))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.bit_count("bits").desc(), "cand_id"))
    shared = spool(joint.withColumn("place", place), "shared")
    chunk = F.pmod(F.xxhash64("s1_id"), F.col("chunks")).alias("chunk")
    members = records.join(classes, "longs").select("s1_id", "class", chunk, "own")
    # What a record's own candidates also share with it through long lists counts for them.
    apart = members.select("s1_id", "class", F.explode("own").alias("o")).select("s1_id", "class", "o.*").join(unsent(shared.select("class", "cand_id", F.col("bits").alias("_bits"))), ["class", "cand_id"], "left")
    bits = F.col("bits").bitwiseOR(F.coalesce("_bits", F.lit(0).cast("long")))
    ranked = F.struct((-F.bit_count("bits")).alias("fewer"), "cand_id", F.lit(0).alias("place"), "bits")
    own = apart.withColumn("bits", bits).repartition(parts, "s1_id").groupBy("s1_id").agg(F.array_sort(F.collect_list(ranked)).alias("own"))
    members = members.drop("own").join(unsent(own), "s1_id", "left").withColumn("own_ids", F.transform("own", lambda o: o["cand_id"]))
    if most is None:
        members = members.withColumn("cut", F.lit(2**31 - 1))
    else:
        members = _cut(members, shared, most, parts)
    some = lambda name: F.coalesce(F.col(name), F.array().cast(members.schema[name].dataType)).alias(name)
    return Blocks(spool(members.select("s1_id", "class", "chunk", "cut", some("own_ids"), some("own")), "members"), shared if most is None else shared.where(F.col("place") <= most), parts)


def _cut(members: DataFrame, shared: DataFrame, most: int, parts: int) -> DataFrame:
    """Members with the place ``cut`` of the last candidate they share, and of their own only those, among the ``most`` best of both.

    A class's order holds for what its records don't have of their own, and the ``most`` first of it are enough.
    """
    in_order = F.array_sort(F.collect_list(F.struct((-F.bit_count("bits")).alias("fewer"), "cand_id", "place", F.lit(None).cast("long").alias("bits"))))
    tops = shared.where(F.col("place") <= most).groupBy("class", "chunks").agg(in_order.alias("top"))
    tops = tops.select("class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "top").repartition(parts, "class", "chunk")
    met = members.repartition(parts, "class", "chunk").join(unsent(tops), ["class", "chunk"], "left")
    others = F.filter("top", lambda t: ~F.array_contains("own_ids", t["cand_id"]))
    both = F.slice(F.array_sort(F.concat(F.coalesce(others, F.array().cast(met.schema["top"].dataType)), "own")), 1, most)
    merged = F.when(F.col("own").isNotNull(), both)
    last = F.coalesce(F.array_max(F.transform("merged", lambda m: m["place"])), F.lit(0))
    out = met.withColumn("merged", merged)
    kept = F.filter("merged", lambda m: m["bits"].isNotNull())
    return out.withColumns({"cut": F.when(F.col("merged").isNull(), F.lit(most)).otherwise(last), "own": kept}).drop("top", "merged")


def rule_blocks(left: DataFrame, right: DataFrame, max_postings: int = 500, most: int | None = None, blockers: dict[str, Keys] | None = None) -> Blocks:
    """``blocks_of`` normalised records, which should be written already, as they are counted and split into keys twice."""
    own = blockers or BLOCKERS
    return blocks_of(blocking_keys(left, own), spool(blocking_keys(right, own), "keys"), sorted(own), max_postings, most, source_parts(left))


def candidates(source_keys: DataFrame, target_keys: DataFrame, max_postings: int = 500, names: list[str] | None = None) -> DataFrame:
    """Pairs (s1_id, cand_id, reasons) that share a key which the targets don't crowd; reasons are the targets' strategies."""
    names = sorted(names or BLOCKERS)
    return met(source_keys, target_keys, names, max_postings).select("s1_id", "cand_id", reasons_of(names))


def capped(pairs: DataFrame, most: int = 150) -> DataFrame:
    """For each s1_id the candidates that most strategies found (by reasons or bits); ties by cand_id."""
    found = F.bit_count("bits") if "bits" in pairs.columns else F.size("reasons")
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(found.desc(), "cand_id"))
    return pairs.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def generate_candidates(s1: DataFrame, s2: DataFrame, s3: DataFrame, most: int = 150, max_postings: int = 500) -> DataFrame:
    """Every s1_id with an array of candidates from both targets; those without any have an empty one. Inputs are normalised."""
    s1 = spool(s1, "normalized")
    blocks = rule_blocks(s1, s2.unionByName(s3), max_postings, most)
    # Members are joined before they meet their lists, so that these don't move again; those of no class are dealt by their ids.
    every = s1.select(F.col("entity_id").alias("s1_id")).join(unsent(blocks.members), "s1_id", "left")
    chunk = F.coalesce("chunk", F.pmod(F.xxhash64("s1_id"), F.lit(blocks.parts)))
    lists = replace(blocks, members=every.withColumn("chunk", chunk)).lists()
    return lists.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


# The fast set: nine classes of keys, each with its own cap.

CLASS_CAPS = {"name_exact": 400, "name_tokbag": 400, "postal": 40, "postal_namepfx": 200, "addr_exact": 100, "addrnum_namepfx": 200, "country_addrnum": 200, "longest_tok": 200, "street_tok": 300}


def fast_keys(records: DataFrame) -> DataFrame:
    """Distinct (entity_id, class, key) of fast records; keys are texts, so that none collide."""
    c = F.col
    words, numbers = F.col("name_words"), F.col("addr_nums")
    first, number = F.try_element_at(words, F.lit(1)), F.try_element_at(numbers, F.lit(1))
    bag = F.array_distinct(words)
    longest = F.transform(F.slice(F.array_sort(F.transform(bag, lambda t: F.struct((-F.length(t)).alias("n"), F.array_position(bag, t).alias("i"), t.alias("t")))), 1, 2), lambda s: s["t"])
    street = F.try_element_at(F.filter("addr_words", lambda t: (F.length(t) >= 5) & ~t.rlike("^[0-9]+$")), F.lit(1))
    own = {
        "name_exact": only(c("fast_name") != "", c("fast_name")),
        "name_tokbag": only(F.size(words) > 0, F.array_join(F.array_sort(bag), " ")),
        "postal": only(c("postal") > 0, c("postal").cast("string")),
        "postal_namepfx": only((c("postal") > 0) & first.isNotNull(), F.concat_ws("#", "postal", F.substring(first, 1, 4))),
        "addr_exact": only(c("fast_addr") != "", c("fast_addr")),
        "addrnum_namepfx": only(number.isNotNull() & first.isNotNull(), F.concat_ws("#", number, F.substring(first, 1, 3))),
        "country_addrnum": only(number.isNotNull() & (c("country_code") != ""), F.concat_ws("#", "country_code", number)),
        "longest_tok": F.filter(longest, lambda t: F.length(t) >= 4),
        "street_tok": only(street.isNotNull(), street),
    }
    each = [named("class", name, keys) for name, keys in own.items()]
    return records.select("entity_id", F.explode(F.array_distinct(F.concat(*each))).alias("k")).select("entity_id", "k.class", "k.key")


def rare_fast_keys(target_keys: DataFrame) -> DataFrame:
    """Without the keys whose postings among the targets exceed their class's cap."""
    cap = F.element_at(F.create_map(*(F.lit(x) for pair in CLASS_CAPS.items() for x in pair)), F.col("class"))
    crowded = spool(target_keys.groupBy("class", "key").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("class", "key"), "crowded")
    return target_keys.join(crowded, ["class", "key"], "left_anti")


def fast_candidates(source_keys: DataFrame, target_keys: DataFrame, rare: bool = False) -> DataFrame:
    """Distinct pairs (s1_id, cand_id) that share a key whose postings among the targets stay within its class's cap.

    rare: whether the target's crowded keys are gone already, as in a bundle.
    """
    right = (target_keys if rare else rare_fast_keys(target_keys)).select(F.col("entity_id").alias("cand_id"), "class", "key")
    return source_keys.withColumnRenamed("entity_id", "s1_id").join(right, ["class", "key"]).select("s1_id", "cand_id").distinct()


def key_coverage(source_keys: DataFrame, target_keys: DataFrame, truth: DataFrame, kind: str = "class") -> DataFrame:
    """For each class of keys, how many true pairs (s1_id, cand_id) share one of its keys, and their share."""
    total = truth.count()
    left = truth.join(source_keys.withColumnRenamed("entity_id", "s1_id"), "s1_id")
    met = left.join(target_keys.withColumnRenamed("entity_id", "cand_id"), ["cand_id", kind, "key"]).select(kind, "s1_id", "cand_id").distinct()
    counted = met.groupBy(kind).agg(F.count("*").alias("covered"))
    return counted.select(kind, "covered", F.round(F.col("covered") / F.lit(max(1, total)), 6).alias("coverage"))
