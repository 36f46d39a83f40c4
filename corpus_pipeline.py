"""The corpus pipeline: language, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import langid, mixing, packing, pii, similar
from linkloom.llm.common import prepare, spool, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found go on, with that language; rejected ones go.

    The models learn from docs as they come in. Null and empty texts, and texts without a letter, are rejected; null
    ids, null sources and repeated rows go on as they are.
    """
    prepare(spark)
    found = langid.identify(docs.select(*COLUMNS), langid.train(docs), COLUMNS)
    return found.where("NOT rejected").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one document stays: the one with the smallest doc_id.

    Near-duplicates have at least 0.8 of their shingles of five words in common (op9 has a rule of its own). Repeated
    rows are one document. A null doc_id comes after all others; ties go to the smallest hash of the text. Null
    texts and texts without words are one component.
    """
    prepare(spark)
    found = similar.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    keepers = found.groupBy("root").agg(first).select(F.struct("first.doc_id", "first.text_hash").alias("row"))
    rows = docs.select(*COLUMNS, F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("row"))
    return rows.join(keepers, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document goes on, its personal data replaced by surrogates, n_chars brought up to date.

    Null texts stay null with null n_chars; empty texts and texts without personal data stay as they are; repeated
    rows stay alike.
    """
    prepare(spark)
    done = pii.pseudonymise(docs.select(*COLUMNS))
    return done.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it, the last of a leaf cut where its budget ends.

    Null lang and source are leaves of their own; texts without words have no tokens and are never taken; repeated
    rows are one document.
    """
    prepare(spark)
    return mixing.mixed_documents(docs.select(*COLUMNS), length="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids with their sequence and place; null and empty texts are the end id alone."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the language models or the search for near-duplicates; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
