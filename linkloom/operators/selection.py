"""Choosing matches from scored pairs by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim
from linkloom.sources.shared import spool


def top_k(pairs: DataFrame, k: int, by: list[str], score: str, tie: list[str]) -> DataFrame:
    """The k best of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), *tie))
    return pairs.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def select_matches(pairs: DataFrame, threshold: float, gap: float, most: int | None = None, group: str = "s1_id", score: str = "score", tie: str = "cand_id") -> DataFrame:
    """Of the pairs at the threshold or above: those within ``gap`` of their group's best, at most ``most``."""
    good = pairs.where(F.col(score) >= threshold)
    ranked = Window.partitionBy(group).orderBy(F.col(score).desc(), tie)
    df = good.withColumns({"_rank": F.row_number().over(ranked), "_top": F.max(score).over(Window.partitionBy(group))})
    near = F.col(score) >= F.greatest(F.lit(threshold), F.col("_top") - gap)
    keep = near if most is None else near & (F.col("_rank") <= most)
    return df.where(keep).drop("_rank", "_top")


def assign_best(pairs: DataFrame, threshold: float = 0.0, query: tuple[str, ...] = ("src", "q_id"), parent: str = "s1_id", p: str = "p") -> DataFrame:
    """Each query's most probable parent, if it reaches the threshold; ties go to the smaller parent."""
    return top_k(pairs, 1, list(query), p, [parent]).where(F.col(p) >= threshold)


def expected_f_select(best: DataFrame, floor: float = 0.05, parent: str = "s1_id", p: str = "p", tie: tuple[str, ...] = ("src", "q_id")) -> DataFrame:
    """For each parent the k most probable records that maximise the expected F0.5, if that beats "no match".

    Totals and the chance of no match count every record; only those at the floor or above can be taken.
    """
    c = F.col
    whole = Window.partitionBy(parent)
    df = best.withColumns({"_total": F.sum(p).over(whole), "_none": F.exp(F.sum(F.log1p(-F.least(c(p), F.lit(1 - 1e-6)))).over(whole))}).where(c(p) >= floor)
    order = Window.partitionBy(parent).orderBy(c(p).desc(), *tie)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("k", F.row_number().over(order)).withColumn("ef", 1.25 * F.sum(p).over(running) / (0.25 * c("_total") + c("k")))
    df = df.withColumn("_best", F.max("ef").over(whole)).withColumn("_k", F.min(F.when(c("ef") == c("_best"), c("k"))).over(whole))
    return df.where((c("k") <= c("_k")) & (c("_best") > c("_none"))).drop("_total", "_none", "_best", "_k")


def prune_candidates(cands: DataFrame, final_k: int = 8, relative: float = 0.6, address_k: int = 4, address_min: float = 0.4) -> DataFrame:
    """Of candidates with their competition: the best by score, and a few by address; the competition's columns go, to be made anew."""
    c = F.col
    keep = ((c("rank") <= final_k) & (c("score") >= relative * (c("score") + c("gap_top")))) | ((c("acos_rank") <= address_k) & (c("acos") >= address_min))
    return cands.where(keep).select("src", "q_id", "s1_id", "score", "ncos", "acos")


def dense_codes(df: DataFrame, by: str, name: str = "code") -> DataFrame:
    """Codes 0, 1, ... of a column's values in their order.

    Distinct values are dealt by range and written with the number of their part; a code is the count of all
    earlier parts and the place within its own, so no task sees all values.
    """
    values = spool(df.select(by).distinct().repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "codes")
    parts = values.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    codes = values.withColumn("_place", place).join(parts.select("_part", earlier.alias("_before")), "_part")
    return df.join(codes.select(by, (F.col("_before") + F.col("_place")).alias(name)), by)


def multi_claimed(matches: DataFrame) -> DataFrame:
    """(cand_id, claims) of candidates that more than one parent claims."""
    return matches.groupBy("cand_id").agg(F.count("*").alias("claims")).where("claims > 1")


def resolve_collisions(matches: DataFrame, records: DataFrame, least: float = 45.0) -> DataFrame:
    """matches (s1_id, cand_id) with one parent for each candidate.

    Where several claim one, names and addresses decide (0.6 and 0.4 of their token-set ratios); the best claimant
    stays if it has ``least``, else none. Ties go to the smaller s1_id.
    """
    many = multi_claimed(matches).select("cand_id")
    clear = matches.join(many, "cand_id", "left_anti").select("s1_id", "cand_id")
    side = lambda key, p: records.select(F.col("entity_id").alias(key), F.lower(F.trim("business_name")).alias(p + "n"), F.lower(F.trim("business_address")).alias(p + "a"))
    claimed = matches.join(many, "cand_id").join(side("s1_id", "l"), "s1_id", "left").join(side("cand_id", "r"), "cand_id", "left")
    score = 0.6 * sim.fuzz_token_set_ratio(F.col("rn"), F.col("ln")) + 0.4 * sim.fuzz_token_set_ratio(F.col("ra"), F.col("la"))
    won = top_k(claimed.withColumn("_score", score), 1, ["cand_id"], "_score", ["s1_id"]).where(F.col("_score") >= least)
    return clear.unionByName(won.select("s1_id", "cand_id"))
