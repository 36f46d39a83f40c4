"""Mixing of sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A total of tokens is handed down: at each node its
children share its budget by weight, and a child whose documents, repeated for the epochs
allowed, can't use its share leaves the rest to its siblings. As a child's limit is that of its
whole subtree, siblings take up a shortage before it reaches an ancestor. Each leaf
then takes whole epochs of its documents and a prefix of one more, in an order seeded
by epoch; the document at which the budget ends counts with the tokens that fit.

Every step is an aggregation or a window. A leaf may hold a third of all documents: its budget is joined to parts
of them, and its prefix is found in slices of its order, sums of slices first, then within slices.

Defined results: null and empty text has no tokens and is never selected; null lang or source
is a leaf of its own (``null``); a repeated row (same doc_id, text, lang, source) counts
once; no rows, or no weight above zero, select nothing; other columns never matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut, join_split, spool

NONE = "null"
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Targets:
    """Weights by name; a name that isn't listed weighs ``other``. Budget: ``share`` of all tokens."""

    domains: dict[str, float] = field(default_factory=lambda: {"web": 5.0, "books": 3.0, "dialogue": 2.0})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 5.0, "de": 2.0, "fr": 2.0})
    sources: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    share: float = 1.0
    max_epochs: int = 4
    seed: int = 17


def domain_of(source: Column) -> Column:
    """The domain of a source: here by the remainder of its number."""
    number = F.try_to_number(F.nullif(F.regexp_extract(source, r"(\d{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("long")
    return F.when(number % 3 == 0, "web").when(number % 3 == 1, "books").when(number % 3 == 2, "dialogue").otherwise("other")


def tokens_of(text: Column) -> Column:
    """Words of the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = n + F.when(text.rlike("^" + SPACE), 2).otherwise(1)  # of a text that begins with blanks, the first part is empty
    split = F.split(text, SPACE, parts.cast("int"))
    rest = F.when(F.size(split) == parts, F.element_at(split, -1)).otherwise("")
    return F.regexp_replace(text.substr(F.lit(1), F.length(text) - F.length(rest)), SPACE + "$", "")


def _weight(name: Column, weights: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for key, value in sorted(weights.items()):
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("double")


def share_out(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Adds ``given`` to nodes (columns parent, ``budget`` of the parent, ``weight``, ``limit``).

    With children in the order of limit per weight, level_i = what is left of the budget per weight left, were
    all before i at their limit. The level at which the budget is used up is the largest of them.
    """
    ratio = F.col("limit") / F.nullif(F.col("weight"), F.lit(0.0))
    ordered = Window.partitionBy(*parent).orderBy(ratio.asc_nulls_last(), *order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # A weight left that rounding makes of nothing is nothing.
    level = F.when((F.col("weight") > 0) & (weight_left > F.col("weight") * 0.5), left / weight_left)
    return nodes.withColumn("_level", level).withColumn("given", F.least("limit", F.col("weight") * F.coalesce(F.max("_level").over(whole), F.lit(0.0)))).withColumn("given", F.greatest("given", F.lit(0.0))).drop("_level")


LEAF = ["domain", "language", "src"]


def budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """leaves (domain, language, src, supply) with ``budget`` in tokens."""
    leaves = leaves.withColumn("limit", (F.col("supply") * targets.max_epochs).cast("double"))
    leaves = leaves.withColumn("limit", F.when(_weight(F.col("src"), targets.sources, targets.other) > 0, F.col("limit")).otherwise(0.0))
    langs = leaves.groupBy("domain", "language").agg(F.sum("limit").alias("limit"), F.sum("supply").alias("supply"))
    langs = langs.withColumn("limit", F.when(_weight(F.col("language"), targets.languages, targets.other) > 0, F.col("limit")).otherwise(0.0))
    domains = langs.groupBy("domain").agg(F.sum("limit").alias("limit"), F.sum("supply").alias("supply"))
    whole = Window.partitionBy(F.lit(1))
    domains = domains.withColumn("budget", F.sum("supply").over(whole) * F.lit(targets.share)).withColumn("weight", _weight(F.col("domain"), targets.domains, targets.other)).withColumn("_all", F.lit(1))
    domains = share_out(domains, ["_all"], ["domain"]).select("domain", F.col("given").alias("budget"))
    langs = langs.join(domains, "domain").withColumn("weight", _weight(F.col("language"), targets.languages, targets.other))
    langs = share_out(langs, ["domain"], ["language"]).select("domain", "language", F.col("given").alias("budget"))
    leaves = leaves.join(langs, ["domain", "language"]).withColumn("weight", _weight(F.col("src"), targets.sources, targets.other))
    leaves = share_out(leaves, ["domain", "language"], ["src"])
    return leaves.select(*LEAF, "supply", F.floor(F.round("given", 3)).cast("long").alias("budget"))


def units(docs: DataFrame) -> DataFrame:
    """Distinct documents: doc_id, lang, source, text_hash, their leaf and n_tokens."""
    rows = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), tokens_of(F.col("text")).alias("n_tokens")).distinct()
    return rows.select("*", domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit(NONE)).alias("language"), F.coalesce("source", F.lit(NONE)).alias("src"))


def mix(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """Per distinct document: its leaf, budget, ``epochs`` (how often it is taken whole) and ``extra_tokens``
    (tokens of it in the prefix of the last epoch; n_tokens if it is whole there too)."""
    rows = cut(units(docs))
    leaves = cut(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("supply")))
    plan = budgets(leaves, targets)
    full = F.coalesce(F.floor(F.try_divide("budget", "supply")), F.lit(0)).cast("int")
    plan = plan.withColumn("epochs", full).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("supply"))
    # The order of the last epoch, in 4,096 slices.
    mark = F.md5(F.concat_ws("-", F.lit(targets.seed), "epochs", "doc_id"))
    # Written, so that its size is known: Spark sends a small one to the rows.
    rows = join_split(rows, spool(plan, "budgets"), LEAF, ["doc_id", "text_hash"], "inner")
    # Dealt by slice, not by leaf: what follows would otherwise keep the join's distribution, and a leaf in one task.
    rows = rows.withColumn("_mark", mark).withColumn("_slice", F.substring("_mark", 1, 3)).repartition(*LEAF, "_slice")
    sums = rows.groupBy(*LEAF, "_slice").agg(F.sum("n_tokens").alias("_sum"))
    earlier = Window.partitionBy(*LEAF).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEAF, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*LEAF, "_slice").orderBy("_mark", "doc_id", "n_tokens", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(sums, [*LEAF, "_slice"])
    extra = F.greatest(F.lit(0), F.least("n_tokens", F.col("rest") - F.col("_before") - F.col("_own")))
    return rows.select("doc_id", "lang", "source", "text_hash", *LEAF, "n_tokens", "budget", "epochs", extra.cast("long").alias("extra_tokens"))


def mixed_documents(docs: DataFrame, targets: Targets = Targets(), length: str | None = None) -> DataFrame:
    """The documents themselves, each as often as it is taken; columns as in docs.

    What the prefix of the last epoch takes of the document at which it ends is a row with the text cut after so many
    words (and their number of characters in the column ``length``, if one is named), so that the rows' tokens add
    up to the budgets.
    """
    cut_off = (F.col("extra_tokens") > 0) & (F.col("extra_tokens") < F.col("n_tokens"))
    whole = F.col("epochs") + F.when(F.col("extra_tokens") == F.col("n_tokens"), 1).otherwise(0)
    # Of each row the number of words: null for all.
    takes = F.concat(F.array_repeat(F.lit(None).cast("long"), whole.cast("int")), F.when(cut_off, F.array("extra_tokens")).otherwise(F.array().cast("array<bigint>")))
    chosen = mix(docs, targets).where("n_tokens > 0").select("doc_id", "lang", "source", "text_hash", takes.alias("takes")).where(F.size("takes") > 0)
    own = F.struct(*docs.columns)  # so that no name of docs meets one of ours
    firsts = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), own.alias("own")).groupBy("doc_id", "lang", "source", "text_hash").agg(F.first("own").alias("own"))
    same = None
    for c in ("doc_id", "lang", "source", "text_hash"):
        here = F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}"))
        same = here if same is None else same & here
    met = firsts.alias("d").join(chosen.alias("c"), same).select("own", F.explode("takes").alias("take"))
    text = F.when(F.col("take").isNull(), F.col("own.text")).otherwise(first_words(F.col("own.text"), F.col("take")))
    met = met.select("own", text.alias("text"))
    new = {"text": F.col("text")} | ({length: F.length("text").cast(docs.schema[length].dataType)} if length else {})
    return met.select(*(new.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def report(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """What op6 returns: the selection per document."""
    return mix(docs, targets).select("doc_id", "domain", "language", F.col("src").alias("source"), "n_tokens", "budget", "epochs", "extra_tokens")


def oracle(targets: Targets = Targets()) -> str:
    """The same in DuckDB's SQL."""

    def weight(name: str, weights: dict[str, float]) -> str:
        cases = " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in sorted(weights.items()))
        return f"CAST({f'CASE {cases} ELSE {targets.other} END' if cases else targets.other} AS DOUBLE)"

    def shared(table: str, keys: str, parent: str, order: str) -> str:
        over = f"PARTITION BY {parent} ORDER BY lim / nullif(w, 0) ASC NULLS LAST, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        return f"""(SELECT *, greatest(0.0, least(lim, w * coalesce(max(level) OVER (PARTITION BY {parent}), 0.0))) AS given FROM (
            SELECT *, CASE WHEN w > 0 AND sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER ({over}), 0) > w * 0.5
              THEN (budget - coalesce(sum(lim) OVER ({over}), 0)) / (sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER ({over}), 0)) END AS level
            FROM {table}))"""

    return rf"""
WITH docs AS (
  SELECT DISTINCT doc_id, lang, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
placed AS (
  SELECT *, CASE TRY_CAST(regexp_extract(source, '(\d{{1,9}})$', 1) AS BIGINT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'dialogue' ELSE 'other' END AS domain,
    coalesce(lang, '{NONE}') AS language, coalesce(source, '{NONE}') AS src FROM docs),
leaves AS (
  SELECT domain, language, src, sum(n_tokens) AS supply, CASE WHEN {weight('src', targets.sources)} > 0 THEN CAST(sum(n_tokens) * {targets.max_epochs} AS DOUBLE) ELSE 0 END AS lim FROM placed GROUP BY ALL),
langs AS (
  SELECT domain, language, sum(supply) AS supply, CASE WHEN {weight('language', targets.languages)} > 0 THEN sum(lim) ELSE 0 END AS lim FROM leaves GROUP BY domain, language),
domains AS (SELECT domain, sum(supply) AS supply, sum(lim) AS lim, 1 AS every FROM langs GROUP BY domain),
d0 AS (SELECT domain, lim, every, (SELECT sum(supply) FROM domains) * CAST({targets.share} AS DOUBLE) AS budget, {weight('domain', targets.domains)} AS w FROM domains),
d1 AS (SELECT domain, given AS budget FROM {shared('d0', 'domain', 'every', 'domain')}),
l0 AS (SELECT l.domain, language, lim, budget, {weight('language', targets.languages)} AS w FROM langs l JOIN d1 USING (domain)),
l1 AS (SELECT domain, language, given AS budget FROM {shared('l0', 'language', 'domain', 'language')}),
s0 AS (SELECT v.domain, v.language, src, supply, lim, budget, {weight('src', targets.sources)} AS w FROM leaves v JOIN l1 USING (domain, language)),
s1 AS (SELECT domain, language, src, supply, CAST(floor(round(given, 3)) AS BIGINT) AS budget FROM {shared('s0', 'src', 'domain, language', 'src')}),
s2 AS (SELECT *, CAST(CASE WHEN supply > 0 THEN budget // CAST(supply AS BIGINT) ELSE 0 END AS INTEGER) AS epochs FROM s1),
r AS (
  SELECT p.*, budget, epochs, CAST(budget - epochs * supply AS BIGINT) AS rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, src ORDER BY md5(concat_ws('-', '{targets.seed}', epochs, doc_id)), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed p JOIN s2 USING (domain, language, src))
SELECT doc_id, domain, language, src AS source, CAST(n_tokens AS BIGINT) AS n_tokens, budget, epochs,
  CAST(greatest(0, least(n_tokens, rest - before)) AS BIGINT) AS extra_tokens FROM r"""
