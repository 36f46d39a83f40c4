"""Deterministic samples, folds and splits: hashes of ids in place of random numbers and row positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), *ids))


def uniform_sample(df: DataFrame, n: int, ids: list[str], seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    """n rows by the smallest hash of their ids, without those whose ids ``exclude`` has."""
    if exclude is not None:
        df = df.join(exclude.select(*ids), ids, "left_anti")
    return df.orderBy(mark(seed, *ids), *ids).limit(n)


def skipping_sample(df: DataFrame, skip: int, n: int, order: list[str]) -> DataFrame:
    """n rows after the first ``skip`` in an order."""
    return df.orderBy(*order).offset(skip).limit(n)


def nth_split(number: Column, every: int = 10) -> Column:
    """Whether a row's number falls in the held-out part."""
    return F.pmod(number, F.lit(every)) == 0


def fold(number: Column, folds: int = 10) -> Column:
    """Knuth's multiplicative hash of a number, into folds."""
    return F.pmod(F.pmod(number.cast("long") * F.lit(2654435761), F.lit(1 << 32)), F.lit(folds))


def query_hash(key: Column, seed: int = 42) -> Column:
    """0 to 999. The key is reduced first, so that no product leaves a long."""
    first = F.pmod(F.pmod(key.cast("long"), F.lit(1 << 31)) * 40503 + seed, F.lit(1 << 31))
    return F.pmod(F.pmod(first * F.lit(2654435761), F.lit(1 << 32)), F.lit(1000))


def validation_queries(pairs: DataFrame, parent_number: Column, query: list[str]) -> DataFrame:
    """Queries any of whose candidates is in fold 0; a query's candidates stay together."""
    return pairs.where(fold(parent_number) == 0).select(*query).distinct()


def negative_sample(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """All positives of pairs (s1_id, cand_id, label), and per parent the max(2, 3 x positives) negatives of smallest hash."""
    per = Window.partitionBy("s1_id")
    positives = F.sum("label").over(per)
    rank = F.row_number().over(Window.partitionBy("s1_id", "label").orderBy(mark(seed, "s1_id", "cand_id"), "cand_id"))
    df = pairs.withColumns({"_p": positives, "_r": rank})
    return df.where((F.col("label") == 1) | (F.col("_r") <= F.greatest(F.lit(2), 3 * F.col("_p")))).drop("_p", "_r")


def labelled(candidates: DataFrame, truth_pairs: DataFrame) -> DataFrame:
    """candidates with ``label``: 1 for true pairs (s1_id, cand_id), 0 for others."""
    return candidates.join(truth_pairs.select("s1_id", "cand_id", F.lit(1).alias("label")), ["s1_id", "cand_id"], "left").fillna({"label": 0})


def training_pairs(candidates: DataFrame, truth_pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Labelled candidates with sampled negatives, and every true pair once more, as the models expect."""
    return negative_sample(labelled(candidates.select("s1_id", "cand_id"), truth_pairs), seed).unionAll(truth_pairs.select("s1_id", "cand_id", F.lit(1).alias("label")))


def stratified_sample(parents: DataFrame, n: int, matched: Column, share: float = 0.8, seed: int = 42) -> DataFrame:
    """n parents, ``share`` of them with matches."""
    want = round(n * share)
    pick = lambda df, m: df.orderBy(mark(seed, "s1_id"), "s1_id").limit(m)
    return pick(parents.where(matched), want).unionByName(pick(parents.where(~matched), n - want))
