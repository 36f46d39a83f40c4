"""Learning how native words are spelled in Latin letters, from matched records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim
from linkloom.functions.folding import ascii_fold
from linkloom.functions.translit import is_nonlatin, raw_tokens, skeleton
from linkloom.operators.sampling import mark
from linkloom.sources.shared import spool

#: Scripts from Devanagari to Sinhala.
NATIVE = r"[\x{0900}-\x{0DFF}]"


def learn(records: DataFrame, s1: DataFrame, truth_pairs: DataFrame, max_pairs: int = 300_000, keep: float = 0.35, seed: int = 0) -> DataFrame:
    """(token, spelling) of native words in matched records, by how often a word or pair of words stands in their parents.

    Taken: a share ``keep`` of the records with native words, at most max_pairs. Kept: words in at least two of them,
    spelled so in a quarter, and either far more often than by chance or alike in sound; the best spelling of each.
    """
    text = lambda: F.concat_ws(" , ", "business_name", "business_address")
    native = records.where(text().rlike(NATIVE)).join(truth_pairs.withColumnRenamed("cand_id", "entity_id"), "entity_id")
    share = F.conv(F.substring(mark(seed, "entity_id"), 1, 6), 16, 10).cast("long") / F.lit(16**6)
    taken = native.where(share <= keep).orderBy(mark(seed + 1, "entity_id")).limit(max_pairs)
    taken = taken.select("entity_id", "s1_id", F.array_distinct(F.filter(raw_tokens(text()), is_nonlatin)).alias("tokens")).where(F.size("tokens") > 0)
    taken = spool(taken, "translearn")
    n = taken.count()
    words = s1.join(taken.select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi").select(F.col("entity_id").alias("s1_id"), raw_tokens(F.lower(ascii_fold(text()))).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    words = words.select("s1_id", F.explode(F.array_distinct(F.concat("w", pairs))).alias("word"))
    tokens = taken.select("entity_id", "s1_id", F.explode("tokens").alias("token"))
    counted = taken.select("entity_id", "s1_id").join(words, "s1_id")
    ct = tokens.groupBy("token").agg(F.count("*").alias("ct")).where("ct >= 2")
    cw = counted.groupBy("word").agg(F.count("*").alias("cw"))
    together = tokens.join(words, "s1_id").groupBy("token", "word").agg(F.count("*").alias("c"))
    df = together.join(ct, "token").withColumn("p", F.col("c") / F.col("ct")).where("p >= 0.25").join(cw, "word")
    sound = lambda c: F.array_join(F.transform(F.split(F.lower(ascii_fold(c)), " "), skeleton), "")
    df = df.withColumns({"lift": F.col("p") - F.col("cw") / F.lit(max(1, n)), "sim": sim.fuzz_ratio(sound(F.col("token")), sound(F.col("word"))) / 100})
    df = df.where("NOT (lift < 0.45 AND sim < 0.5)").withColumn("score", F.col("lift") + F.col("p") + 2 * F.col("sim"))
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.col("score").desc(), "word"))
    return df.withColumn("_r", rank).where("_r = 1").select("token", F.col("word").alias("spelling"), "score")
