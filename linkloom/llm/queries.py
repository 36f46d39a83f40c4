"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.llm import alignment, ann, conversations, langid, licenses, mixing, packing, pii, ppm, quality, simhash, urlfilter, warc
from linkloom.llm.common import table


def op1_nearest(spark, sf_dir):
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20"""


def op2_surrogates(spark, sf_dir):
    """Every document with its personal data replaced."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality(spark, sf_dir):
    """Base counts and compression verdict of every document."""
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_licenses(spark, sf_dir):
    """Base phrases and licence labels of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    """The place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_mixture(spark, sf_dir):
    """What the mixture takes of every document."""
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_urls(spark, sf_dir):
    """The rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.listed_urls(pages))


def op8_revisits(spark, sf_dir):
    """The response behind every revisit of the crawl that the pages stand for."""
    return warc.resolve(warc.capture_log(table(spark, sf_dir, "pages")))


def op9_simhash(spark, sf_dir):
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_language(spark, sf_dir):
    """Predicted language of every document; models come from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs), ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op11_ppm(spark, sf_dir):
    """Every document's log-probability by words alone and by PPM, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = ppm.score(docs, ~ppm.held_out(F.col("doc_id")))
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_conversations(spark, sf_dir):
    """Every conversation after the damage: its faults, the cheapest repair and the digest of what it gives."""
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op13_alignment(spark, sf_dir):
    """How every document's tokens align between two tokenizers, and how common its linked pairs are."""
    return alignment.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_surrogates": op2_surrogates,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_packing": op5_packing,
    "op6_mixture": op6_mixture,
    "op7_urls": op7_urls,
    "op8_revisits": op8_revisits,
    "op9_simhash": op9_simhash,
    "op10_language": op10_language,
    "op11_ppm": op11_ppm,
    "op12_conversations": op12_conversations,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op1_nearest": OP1_SQL,
    "op6_mixture": mixing.oracle(),
    "op7_urls": urlfilter.oracle(),
    "op11_ppm": ppm.oracle(),
    "op12_conversations": conversations.oracle(),
    "op8_revisits": warc.oracle(urlfilter.CANONICAL_SQL),
}
