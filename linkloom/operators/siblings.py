"""Records that confidently belong to a parent help to place others: expansion by their keys, features by likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim
from linkloom.functions.text import words_of
from linkloom.functions.translit import skeleton
from linkloom.operators.selection import top_k
from linkloom.sources.shared import unsent

QUERY = ["src", "q_id"]


def confident(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(src, q_id, s1_id, p1): each query's best parent, if it has at least this probability."""
    return top_k(pairs, 1, QUERY, "p1", ["s1_id"]).where(F.col("p1") >= least).select(*QUERY, "s1_id", "p1")


def street() -> Column:
    return F.coalesce(skeleton(F.try_element_at(F.filter(words_of(F.col("a_words")), lambda w: F.length(w) >= 4), F.lit(1))), F.lit(""))


def sibling_keys(records: DataFrame) -> DataFrame:
    """(src, q_id, key) of prepared records, within their country."""
    c = F.col
    key = lambda kind, value, when: F.when(when, F.concat_ws("|", "country", F.lit(kind), value))
    own = F.array_compact(F.array(
        key("addr", c("a_norm"), F.length("a_norm") >= 8), key("name", c("n_core"), F.length("n_core") >= 4), key("skel", c("n_skel"), F.length("n_skel") >= 4),
        key("num", F.concat_ws("|", "a_first_num", street()), (c("a_first_num") != "") & (street() != "")),
    ))
    return records.select(*QUERY, F.explode(own).alias("key"))


def expand(pairs: DataFrame, records: DataFrame, max_parents: int = 3) -> DataFrame:
    """New pairs (src, q_id, s1_id, n_keys): queries without a confident parent that share keys with queries that have one.

    Keys that lead to more than ``max_parents`` parents say too little and are dropped.
    """
    sure = confident(pairs).select(*QUERY, "s1_id")
    keys = sibling_keys(records)
    parents = keys.join(unsent(sure), QUERY).select("key", "s1_id").distinct()
    telling = parents.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= max_parents).select("key")
    weak = keys.join(unsent(sure.select(*QUERY)), QUERY, "left_anti")
    found = weak.join(unsent(parents.join(unsent(telling), "key", "left_semi")), "key").groupBy(*QUERY, "s1_id").agg(F.count("*").alias("n_keys"))
    return found.join(unsent(pairs.select(*QUERY, "s1_id")), [*QUERY, "s1_id"], "left_anti")


def sibling_pairs(pairs: DataFrame, cap: int = 64, parts: int | None = None) -> DataFrame:
    """Each pair with its parent's confident records but itself, at most ``cap`` of them: src, q_id, s1_id, sib_src, sib_q, sib_p.

    parts: how many tasks the parents are dealt to, where the session's number of partitions wouldn't grow with the pairs.
    """
    dealt = lambda df: df.repartition(parts, "s1_id") if parts else df
    best = top_k(dealt(confident(pairs)), cap, ["s1_id"], "p1", QUERY)
    sibs = best.select("s1_id", F.col("src").alias("sib_src"), F.col("q_id").alias("sib_q"), F.col("p1").alias("sib_p"))
    return dealt(pairs.select(*QUERY, "s1_id")).join(unsent(sibs), "s1_id").where((F.col("src") != F.col("sib_src")) | (F.col("q_id") != F.col("sib_q")))


def sibling_numbers(pairs: DataFrame, records: DataFrame, cap: int = 64) -> DataFrame:
    """Per pair with siblings: how many, whether a sibling's first number is the same, and the best Jaccard of numbers (0 to 100)."""
    side = lambda p, q, s: records.select(F.col("src").alias(s), F.col("q_id").alias(q), F.col("a_first_num").alias(p + "fn"), F.col("a_nums").alias(p + "nm"))
    met = sibling_pairs(pairs, cap).join(side("x", "q_id", "src"), QUERY).join(side("y", "sib_q", "sib_src"), ["sib_src", "sib_q"])
    same = F.when(F.col("xfn") == "", -1).otherwise((F.col("xfn") == F.col("yfn")).cast("int"))
    return met.groupBy(*QUERY, "s1_id").agg(F.count("*").alias("n_sib"), F.max(same).alias("sib_fn"), F.max(sim.jaccard100(F.col("xnm"), F.col("ynm"))).cast("tinyint").alias("sib_nj"))


SIBLING = ["n_sib", "sib_rn", "sib_ra", "sib_nn", "sib_an", "sib_tnn", "sib_tan", "sib_exn", "sib_exa", "sib_fn", "ss_ra", "ss_rn", "sib_p_ra", "sib_nj"]


def sibling_features(pairs: DataFrame, records: DataFrame, cap: int = 64) -> DataFrame:
    """Adds the 14 features (SIBLING): the best likeness of each pair's record to its parent's siblings.

    records: prepared, with raw name and address. Percentages are cut to whole numbers; -2: no sibling, -1: no address.
    """
    c = F.col
    names = {"rn": F.lower("business_name"), "ra": F.lower("business_address"), "nn": c("n_norm"), "an": c("a_norm"), "fn": c("a_first_num"), "nm": c("a_nums")}
    side = lambda p, q, s: records.select(F.col("src").alias(s), F.col("q_id").alias(q), *(v.alias(p + k) for k, v in names.items()))
    met = sibling_pairs(pairs, cap).join(unsent(side("x_", "q_id", "src")), QUERY).join(unsent(side("y_", "sib_q", "sib_src")), ["sib_src", "sib_q"])
    empty = c("x_an") == ""
    addr = lambda v: F.when(empty, F.lit(-1.0)).otherwise(v)
    met = met.withColumns({
        "r_rn": sim.fuzz_ratio(c("x_rn"), c("y_rn")), "r_ra": addr(sim.fuzz_ratio(c("x_ra"), c("y_ra"))), "r_nn": sim.fuzz_ratio(c("x_nn"), c("y_nn")), "r_an": addr(sim.fuzz_ratio(c("x_an"), c("y_an"))),
        "t_nn": sim.fuzz_token_set_ratio(c("x_nn"), c("y_nn")), "t_an": addr(sim.fuzz_token_set_ratio(c("x_an"), c("y_an"))),
        "exn": (c("x_rn") == c("y_rn")).cast("int"), "exa": ((c("x_ra") == c("y_ra")) & ~empty).cast("int"),
        "fn": F.when(c("x_fn") == "", -1).otherwise((c("x_fn") == c("y_fn")).cast("int")), "nj": sim.jaccard100(c("x_nm"), c("y_nm")),
    }).withColumn("p_ra", addr(c("r_ra") * c("sib_p")))
    whole = lambda name: F.least(F.max(name), F.lit(100.0)).cast("tinyint")
    here = lambda name: F.max(F.when(c("src") == c("sib_src"), c(name))).cast("tinyint")
    found = met.groupBy(*QUERY, "s1_id").agg(
        F.least(F.count("*"), F.lit(32000)).cast("smallint").alias("n_sib"), whole("r_rn").alias("sib_rn"), whole("r_ra").alias("sib_ra"), whole("r_nn").alias("sib_nn"), whole("r_an").alias("sib_an"),
        whole("t_nn").alias("sib_tnn"), whole("t_an").alias("sib_tan"), whole("exn").alias("sib_exn"), whole("exa").alias("sib_exa"), whole("fn").alias("sib_fn"),
        here("r_ra").alias("ss_ra"), here("r_rn").alias("ss_rn"), whole("p_ra").alias("sib_p_ra"), whole("nj").alias("sib_nj"),
    )
    return pairs.join(unsent(found), [*QUERY, "s1_id"], "left").fillna({n: (0 if n == "n_sib" else -2) for n in SIBLING})
