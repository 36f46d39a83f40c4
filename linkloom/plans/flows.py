"""Whole flows of record linkage, from records to id lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from linkloom.functions.text import fast_records, normalized_records
from linkloom.functions.translit import prepared
from linkloom.operators import blocking, evaluation, models, pairs, sampling, selection, siblings, tfidf
from linkloom.sources.io import CANDIDATE_HEADER, MATCH_HEADER, Bundle, has_bundle, id_lists, read_bundle, truth_pairs, write_bundle, write_resumable
from linkloom.sources.shared import spool, unsent


@dataclass(frozen=True)
class LinkConfig:
    """All settings of the rule and fast flows in one place."""

    max_postings: int = 500
    max_candidates: int = 150
    threshold: float = 0.62
    gap: float = 0.15
    max_matches: int | None = None
    fast_candidates: int = 25
    fast_threshold: float = 0.45
    fast_gap: float = 0.30
    fast_matches: int = 10


def _numbered_candidates(s1: DataFrame, targets: DataFrame, config: LinkConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(s1_id, cand_id, bits) by numbers, and both sides with entity_id and number. Targets' numbers ascend with their ids, so ties go as by id."""
    number = F.monotonically_increasing_id()
    left = spool(s1.withColumn("number", number), "left")
    right = spool(targets.orderBy("entity_id").withColumn("number", number), "right")
    by_number = lambda df: df.withColumn("entity_id", F.col("number"))
    return spool(rule_blocks(by_number(left), by_number(right), config).pairs(), "pairs"), left, right


def _with_ids(cands: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    ids = lambda df, key: df.select(F.col("number").alias(key), F.col("entity_id").alias(f"_{key}"))
    met = cands.join(ids(right, "cand_id"), "cand_id").join(ids(left, "s1_id"), "s1_id")
    return met.select(F.col("_s1_id").alias("s1_id"), F.col("_cand_id").alias("cand_id"), blocking.reasons_of(sorted(blocking.BLOCKERS)))


def rule_candidates(s1: DataFrame, targets: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """(s1_id, cand_id, reasons) of normalised records, which should be written already."""
    pairs = rule_blocks(s1, targets, config).pairs()
    return pairs.select("s1_id", "cand_id", blocking.reasons_of(sorted(blocking.BLOCKERS)))


def rule_blocks(s1: DataFrame, targets: DataFrame, config: LinkConfig = LinkConfig()) -> blocking.Blocks:
    """The capped candidates of normalised records as classes of records with what they share, and a few pairs of their own."""
    return blocking.rule_blocks(s1, targets, config.max_postings, config.max_candidates)


def rule_pairs(s1: DataFrame, targets: DataFrame, config: LinkConfig = LinkConfig(), columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """rule_candidates, and the same pairs (s1_id, cand_id) with both sides, which are joined by number.

    columns: those of the records that the sides get; all that features compare, with their sets, if none are named.
    """
    cands, left, right = _numbered_candidates(s1, targets, config)
    by_number = lambda df: df.withColumns({"id": F.col("entity_id"), "entity_id": F.col("number")})
    join = pairs.compared_sides if columns is None else pairs.with_sides
    met = join(cands.select("s1_id", "cand_id"), by_number(left), by_number(right), ["id", *(pairs.SIDE if columns is None else columns)])
    return _with_ids(cands, left, right), met.drop("s1_id", "cand_id").withColumnsRenamed({"l_id": "s1_id", "r_id": "cand_id"})


def rule_flow(s1: DataFrame, targets: DataFrame, config: LinkConfig = LinkConfig(), matcher: models.Matcher | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, matches) of raw records: block, compare, score, select."""
    left, right = spool(normalized_records(s1), "normalized"), spool(normalized_records(targets), "normalized")
    cands, met = rule_pairs(left, right, config)
    scored = (matcher or models.RuleMatcher()).score(pairs.pair_features(met)).select("s1_id", "cand_id", "score")
    return cands, selection.select_matches(scored, config.threshold, config.gap, config.max_matches)


_PAYLOAD = ["id", *dict.fromkeys([*pairs.CODES, *pairs.SIGNS, *pairs.FAST_SIDE])]


def _numbered(records: DataFrame) -> DataFrame:
    """Raw records normalised and written once, with a number each in place of their id, which is kept as ``id``."""
    coded = pairs.with_signatures(pairs.fast_codes(fast_records(records))).withColumnRenamed("entity_id", "id").withColumn("entity_id", F.monotonically_increasing_id())
    return spool(coded.select("entity_id", *_PAYLOAD, *(c for c in coded.columns if c not in _PAYLOAD and c != "entity_id")), "fast")


def write_targets(targets: DataFrame, path: str, buckets: int | None = None) -> None:
    """The targets of the fast flow as a bundle, which any number of runs can read."""
    right = _numbered(targets)
    write_bundle(spool(blocking.rare_fast_keys(spool(blocking.fast_keys(right), "fast-keys")), "rare-keys"), right.select("entity_id", *_PAYLOAD), path, buckets=buckets)


BOUND_SLACK = 1e-8  # scores are rounded to nine digits


def cheap_best(cands: DataFrame, left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(s1_id, cand_id, _s1, _cand, cheap): of each s1_id's pairs of numbers the k best by the cheap score, ties by the candidate's own id.

    Signatures bound every pair's score. The k likeliest of each record are scored exactly; what the least of them scores is a floor,
    and of the other pairs only those whose bound reaches it are scored at all.
    """
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.col("bound").desc(), "cand_id"))
    bounds = pairs.with_sides(cands, left, right, pairs.SIGNS).select("s1_id", "cand_id", pairs.cheap_bound().alias("bound"))
    ranked = spool(bounds.withColumn("_rank", rank), "bounds")

    def scored(some: DataFrame) -> DataFrame:
        met = pairs.with_sides(some.select("s1_id", "cand_id"), left, right, ["id", *pairs.CODES])
        return met.select("s1_id", "cand_id", F.col("l_id").alias("_s1"), F.col("r_id").alias("_cand"), F.round(pairs.cheap_score(), 9).alias("cheap"))

    first = spool(scored(ranked.where(F.col("_rank") <= k)), "likeliest")
    floors = first.groupBy("s1_id").agg(F.min("cheap").alias("floor"))  # of k pairs; a record with fewer has no others
    others = ranked.where(F.col("_rank") > k).join(floors, "s1_id").where(F.col("bound") >= F.col("floor") - BOUND_SLACK)
    return selection.top_k(first.unionByName(scored(others)), k, ["s1_id"], "cheap", ["_cand"])


def fast_pairs(s1: DataFrame, targets: DataFrame | Bundle, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Compared pairs of raw records by the fast set: candidates by capped keys, the best by the cheap score, their features.

    Records are normalised once and written with a number each; all raw pairs are pairs of numbers, and only the best get the
    columns that features read. targets: raw records, or a bundle of them, whose two tables are joined where they lie.
    """
    left = _numbered(s1)
    if isinstance(targets, Bundle):
        right, cands = targets.payload, blocking.fast_candidates(blocking.fast_keys(left), targets.keys, rare=True)
    else:
        right = _numbered(targets)
        cands = blocking.fast_candidates(blocking.fast_keys(left), spool(blocking.fast_keys(right), "fast-keys"))
    best = cheap_best(cands, left, right, config.fast_candidates)
    met = pairs.with_sides(best, left, right, pairs.FAST_SIDE).drop("s1_id", "cand_id").withColumnsRenamed({"_s1": "s1_id", "_cand": "cand_id"})
    return pairs.fast_features(met)


def fast_matches(compared: DataFrame, model: models.Matcher, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Matches (s1_id, cand_id, score) of compared pairs by a fitted model."""
    scored = model.score(compared).select("s1_id", "cand_id", "score")
    return selection.select_matches(scored, config.fast_threshold, config.fast_gap, config.fast_matches)


def fast_flow(s1: DataFrame, targets: DataFrame | Bundle, model: models.Matcher, config: LinkConfig = LinkConfig()) -> tuple[DataFrame, DataFrame]:
    """(candidates, matches) of raw records by a fitted model over the fast features; pairs are compared once."""
    compared = spool(fast_pairs(s1, targets, config), "compared")
    return compared.select("s1_id", "cand_id"), fast_matches(compared, model, config)


def diagnose_keys(s1: DataFrame, targets: DataFrame, truth_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of raw records and their true pairs: (class, covered, coverage) by class of fast keys, and the pairs (s1_id, cand_id) that share no key."""
    left, right = spool(blocking.fast_keys(fast_records(s1)), "fast-keys"), spool(blocking.fast_keys(fast_records(targets)), "fast-keys")
    shared = truth_pairs.join(left.withColumnRenamed("entity_id", "s1_id"), "s1_id").join(right.withColumnRenamed("entity_id", "cand_id"), ["cand_id", "class", "key"])
    return blocking.key_coverage(left, right, truth_pairs), evaluation.missed_pairs(truth_pairs, shared.select("s1_id", "cand_id"))


def honest_evaluation(s1: DataFrame, targets: DataFrame, truth: DataFrame, thresholds: list[float], every: int = 10, config: LinkConfig = LinkConfig()) -> list[tuple[float, Row]]:
    """(threshold, scores) of the fast flow on S1 records that the model has never seen, one of ``every`` by the hash of its id.

    The model learns from the others, without the targets that belong to held-out records; those are compared with all targets.
    """
    out = lambda key: sampling.nth_split(F.pmod(F.xxhash64(key), F.lit(1 << 31)), every)
    held, own = truth.where(out("s1_id")), truth.where(~out("s1_id"))
    theirs = truth_pairs(held).select(F.col("cand_id").alias("entity_id")).distinct()
    learned = spool(fast_pairs(s1.where(~out("entity_id")), targets.join(theirs, "entity_id", "left_anti"), config), "compared")
    model = fit_fast_model(learned, truth_pairs(own))
    scored = spool(model.score(fast_pairs(s1.where(out("entity_id")), targets, config)).select("s1_id", "cand_id", "score"), "scored")
    found = lambda t: selection.select_matches(scored, t, config.fast_gap, config.fast_matches)
    return [(t, evaluate(found(t), held).first()) for t in thresholds]


def fit_fast_model(compared: DataFrame, truth_pairs: DataFrame) -> models.StumpModel:
    """Boosted stumps from labelled, sampled pairs."""
    labelled = sampling.labelled(compared, truth_pairs)
    x, y = models.bounded_sample(sampling.negative_sample(labelled.select("s1_id", "cand_id", "label", *pairs.FAST_FEATURES)), pairs.FAST_FEATURES, "label", ["s1_id", "cand_id"])
    return models.fit_stumps(x, y, pairs.FAST_FEATURES)


# Two stages.

CONTEXT = ["rank", "gap_top", "margin", "n_cand_q", "ncos", "ncos_gap", "ncos_rank", "acos", "acos_gap", "acos_rank", "rank_s1", "gap_top_s1", "n_cand_s1", "n_top1_s1"]
FUZZY = [
    "n_ratio", "n_tset", "n_tsort", "c_ratio", "c_tset", "c_tsort", "c_partial", "c_wratio", "cp_jw", "cp_lev", "sk_tset", "sk_ratio", "dom_ratio", "dom_partial", "alt_tset", "c_overlap", "c_inter",
    "l_ntok", "r_ntok", "r_nonlatin", "first_tok_ratio", "name_num", "r_addr_empty", "a_tset", "a_tsort", "a_ratio", "a_partial", "aw_tset", "aw_overlap", "aw_inter", "num_overlap", "num_inter",
    "num_r_extra", "num_l_extra", "num_jacc", "first_num_eq", "first_num_lev", "first_num_in", "postal_eq", "state_eq",
]
STAGE2 = ["p1", "p_rank_q", "p_other_q", "p_sum_q", "p_rank_s1", "p_top_s1", "p_sum_s1", "n_win_s1", *siblings.SIBLING, "n_keys"]


def prepared_queries(s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Prepared records of both targets as queries (src, q_id)."""
    each = lambda df, n: df.withColumns({"src": F.lit(n), "q_id": F.col("entity_id")})
    return prepared(each(s2, 2).unionByName(each(s3, 3)))


def block(queries: DataFrame, s1: DataFrame) -> DataFrame:
    """Pruned candidates with their competition; queries and s1 (with s1_id) prepared."""
    raw = pairs.competition(tfidf.similarity_join(queries, s1, ["src", "q_id"]))
    return pairs.competition(selection.prune_candidates(raw))


def featured(cands: DataFrame, queries: DataFrame, s1: DataFrame) -> DataFrame:
    """cands with the fuzzy features of both sides."""
    left = s1.select("s1_id", *(F.col(c).alias(f"l_{c}") for c in pairs.FORMS))
    right = queries.select("src", "q_id", *(F.col(c).alias(f"r_{c}") for c in pairs.FORMS))
    sided = pairs.fuzzy_features(cands.join(unsent(left), "s1_id").join(unsent(right), ["src", "q_id"]))
    return sided.drop(*(p + c for p in ("l_", "r_") for c in pairs.FORMS))


def expanded(p1: DataFrame, cands: DataFrame, queries: DataFrame, s1: DataFrame) -> DataFrame:
    """Candidates that siblings' keys add to those of the first stage, compared and in competition with the old ones."""
    new = tfidf.pair_cosines(siblings.expand(p1, queries), queries, s1, ["src", "q_id"])
    columns = ["src", "q_id", "s1_id", "score", "ncos", "acos"]
    both = pairs.competition(cands.select(*columns).unionByName(new.select(*columns)))
    return featured(both.join(unsent(new.select("src", "q_id", "s1_id", "n_keys")), ["src", "q_id", "s1_id"]), queries, s1)


def _number_of(name: str):
    """The digits at an id's end; of an id without any (or with too many), a number from its hash."""
    return F.coalesce(F.regexp_extract(name, "([0-9]+)$", 1).try_cast("long"), F.pmod(F.xxhash64(name), F.lit(1_000_000_000)))


def two_stage(s1: DataFrame, s2: DataFrame, s3: DataFrame, truth_pairs: DataFrame, rounds: int = models.ROUNDS) -> DataFrame:
    """All candidates (src, q_id, s1_id, p1, p2), trained and scored on the given records.

    Tables that later steps read again are written to the shared folder; trees fit on training queries, out of fold for p1.
    """
    queries = prepared_queries(s2, s3)
    parents = prepared(s1).withColumn("s1_id", F.col("entity_id"))
    queries, parents = spool(queries, "queries"), spool(parents, "parents")
    cands = spool(featured(spool(block(queries, parents), "blocked"), queries, parents), "candidates")
    number = _number_of("s1_id")
    own = truth_pairs.select(F.col("s1_id"), F.col("cand_id").alias("q_id"), F.lit(1).alias("label"))
    val = sampling.validation_queries(cands, number, ["src", "q_id"]).withColumn("is_val", F.lit(True))
    key = F.col("src").cast("long") * 1_000_000_000 + _number_of("q_id")
    marked = spool(cands.join(unsent(own), ["s1_id", "q_id"], "left").join(unsent(val), ["src", "q_id"], "left").fillna({"label": 0, "is_val": False}).withColumn("qhash", sampling.query_hash(key)), "marked")
    first = ["src", *CONTEXT, *FUZZY]
    fitted = models.stage1(marked, first, rounds)
    scored = spool(models.stage1_probability(fitted, marked.withColumn("n_keys", F.lit(0).cast("long"))), "stage1")
    extra = expanded(scored.select("src", "q_id", "s1_id", "p1"), cands, queries, parents).join(unsent(own), ["s1_id", "q_id"], "left").join(unsent(val), ["src", "q_id"], "left").fillna({"label": 0, "is_val": False})
    extra = models.stage1_probability(fitted, extra.withColumn("qhash", sampling.query_hash(key)))
    columns = ["src", "q_id", "s1_id", "label", "is_val", "qhash", "p1", "n_keys", *CONTEXT, *FUZZY]
    everything = scored.select(*columns).unionByName(extra.select(*columns)).dropDuplicates(["src", "q_id", "s1_id"])
    everything = spool(pairs.probability_context(everything), "everything")
    second = spool(siblings.sibling_features(everything, queries), "stage2")
    names = list(dict.fromkeys([*first, *STAGE2]))
    model = models.fit_trees(second, names, F.lit(True), rounds, rate=0.08)
    return models.with_probability(model, second, "p2").select("src", "q_id", "s1_id", "p1", "p2", "label", "is_val")


def final_matches(scored: DataFrame) -> DataFrame:
    """(s1_id, cand_id): every record's best parent, then the sets of most expected F0.5."""
    best = selection.assign_best(scored.withColumn("p", F.col("p2")), 0.0)
    return selection.expected_f_select(best).select("s1_id", F.col("q_id").alias("cand_id"))


def outputs(matches: DataFrame, cands: DataFrame, s1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables to write; matches are held to the candidates."""
    required = s1.select(F.col("entity_id").alias("s1_id"))
    inside = matches.select("s1_id", "cand_id").join(cands.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi")
    return id_lists(inside, required, MATCH_HEADER), id_lists(cands.select("s1_id", "cand_id"), required, CANDIDATE_HEADER)


def submit(s1: DataFrame, targets: DataFrame, model: models.Matcher, out: str, config: LinkConfig = LinkConfig(), bundle: str | None = None, buckets: int = 16, at_once: int = 4) -> list[int]:
    """Both lists of every S1 under ``out``/buckets, by buckets of its id; returns the buckets this run made.

    The targets' bundle is written once, to ``bundle`` or beside the lists. A run after one that broke off normalises, blocks and
    compares only the S1 of the buckets that are missing.
    """
    spark, at = s1.sparkSession, bundle or f"{out}/targets"
    if not has_bundle(spark, at):
        write_targets(targets, at)
    held = read_bundle(spark, at)

    def lists(part: DataFrame) -> DataFrame:
        part = part.drop("s1_id")
        cands, found = fast_flow(part, held, model, config)
        matches, candidates = (t.withColumnRenamed(CANDIDATE_HEADER[0], "s1_id") for t in outputs(found, cands, part))
        return matches.join(candidates, "s1_id")

    return write_resumable(s1.withColumn("s1_id", F.col("entity_id")), f"{out}/buckets", "s1_id", buckets, lists, at_once)


def evaluate(matches: DataFrame, truth: DataFrame) -> DataFrame:
    lists = matches.groupBy("s1_id").agg(F.collect_set("cand_id").alias("ids"))
    return evaluation.evaluate_matching(truth, lists)
