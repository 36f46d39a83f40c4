"""Evaluation of matches and candidates, profiles, integrity and submission checks.

Truth and predictions are long tables of pairs with a table of all parents beside them; every report is
aggregations and joins, one row in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import normalize_country, normalize_text, words_of
from linkloom.operators.blocking import Blocks


def f_beta(p: Column, r: Column, beta: float = 0.5) -> Column:
    b = beta**2
    return F.when(p + r == 0, 0.0).otherwise((1 + b) * p * r / F.nullif(b * p + r, F.lit(0.0)))


def entity_scores(truth: DataFrame, predicted: DataFrame, parents: DataFrame | None = None, scope: str = "union") -> DataFrame:
    """Per s1_id: n_true, n_pred, tp, precision, recall, f05.

    truth, predicted: lists (s1_id, ids), one row each. scope: ``union`` of both's parents, or their ``intersection``; or the given parents.
    """
    t, p = truth.select("s1_id", F.array_distinct("ids").alias("t")), predicted.select("s1_id", F.array_distinct("ids").alias("p"))
    both = t.join(p, "s1_id", "inner" if scope == "intersection" else "full")
    if parents is not None:
        both = parents.select("s1_id").distinct().join(both, "s1_id", "left")
    none = F.array().cast("array<string>")
    both = both.select("s1_id", F.coalesce("t", none).alias("t"), F.coalesce("p", none).alias("p"))
    c = F.col
    df = both.select("s1_id", F.size("t").alias("n_true"), F.size("p").alias("n_pred"), F.size(F.array_intersect("t", "p")).alias("tp"))
    empty = (c("n_true") == 0) & (c("n_pred") == 0)
    some = (c("n_true") > 0) & (c("n_pred") > 0)
    df = df.withColumns({"precision": F.when(empty, 1.0).when(some, c("tp") / c("n_pred")).otherwise(0.0), "recall": F.when(empty, 1.0).when(some, c("tp") / c("n_true")).otherwise(0.0)})
    return df.withColumn("f05", F.when(empty, 1.0).otherwise(f_beta(c("precision"), c("recall"))))


def evaluate_matching(truth: DataFrame, predicted: DataFrame, scope: str = "union") -> DataFrame:
    """One row: macro precision, recall, f05, f1 (of the macro values), pair counts, singletons."""
    c = F.col
    per = entity_scores(truth, predicted, scope=scope)
    mean = lambda name: F.coalesce(F.avg(name), F.lit(1.0))
    count = lambda x: F.coalesce(F.sum(x), F.lit(0))
    single_t, single_p = c("n_true") == 0, c("n_pred") == 0
    df = per.agg(
        mean("precision").alias("precision"), mean("recall").alias("recall"), mean("f05").alias("f05"),
        count("n_true").alias("true_pairs"), count("n_pred").alias("predicted_pairs"), count("tp").alias("true_positives"),
        F.count_if(single_t).alias("true_singletons"), F.count_if(single_p).alias("predicted_singletons"), F.count_if(single_t & single_p).alias("_right"),
    )
    return df.select(
        "precision", "recall", "f05", f_beta(c("precision"), c("recall"), 1.0).alias("f1"), "true_pairs", "predicted_pairs", "true_positives",
        (c("predicted_pairs") - c("true_positives")).alias("false_positives"), (c("true_pairs") - c("true_positives")).alias("false_negatives"), "true_singletons", "predicted_singletons",
        F.when(c("true_singletons") > 0, c("_right") / c("true_singletons")).otherwise(1.0).alias("singleton_accuracy"),
    )


def evaluate_blocking(truth: DataFrame, candidates: DataFrame, n_targets: int) -> DataFrame:
    """One row: recall, counts, mean, upper median, 95th percentile and most candidates per parent, reduction of the search space.

    Median and percentile are exact, from the histogram of counts: a row for each count that occurs.
    """
    none = F.array().cast("array<string>")
    met = truth.select("s1_id", F.array_distinct("ids").alias("t")).join(candidates.select("s1_id", F.array_distinct("ids").alias("c")), "s1_id", "left").select("t", F.coalesce("c", none).alias("c"))
    return blocking_report(met.select(F.size("t").alias("n_true"), F.size("c").alias("n"), F.size(F.array_intersect("t", "c")).alias("covered")), n_targets)


def evaluate_blocks(truth: DataFrame, blocks: Blocks, n_targets: int) -> DataFrame:
    """``evaluate_blocking`` of pairs that aren't made: only counts and true pairs move."""
    true = truth.select("s1_id", F.array_distinct("ids").alias("t"))
    covered = blocks.holding(true.select("s1_id", F.explode("t").alias("cand_id"))).groupBy("s1_id").agg(F.count("*").cast("int").alias("covered"))
    per = true.select("s1_id", F.size("t").alias("n_true")).join(blocks.counts(), "s1_id", "left").join(covered, "s1_id", "left")
    return blocking_report(per.select("n_true", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("covered", F.lit(0)).alias("covered")), n_targets)


def blocking_report(per: DataFrame, n_targets: int) -> DataFrame:
    """``evaluate_blocking`` of one row (n_true, n, covered) for each parent."""
    by_count = per.groupBy("n").agg(F.count("*").alias("parents"), F.sum("n_true").alias("n_true"), F.sum("covered").alias("covered"))
    hist = by_count.agg(
        F.sum("n_true").alias("total_true"), F.sum("covered").alias("covered"), F.sum(F.col("n") * F.col("parents")).alias("total_candidates"), F.sum("parents").alias("parents"), F.max("n").alias("most"),
        F.array_sort(F.collect_list(F.struct("n", "parents"))).alias("hist"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"))
    # The count of the parent at 0-based place k, walking the histogram.
    place = lambda k: F.aggregate("hist", zero, lambda acc, h: F.struct((acc["seen"] + h["parents"]).alias("seen"), F.when(acc["at"].isNull() & (acc["seen"] + h["parents"] > k), h["n"]).otherwise(acc["at"]).alias("at")), lambda acc: acc["at"])
    c = F.col
    p95 = F.greatest(F.lit(0), F.ceil(c("parents") * F.lit(0.95)) - 1)
    return hist.select(
        F.when(c("total_true") > 0, c("covered") / c("total_true")).otherwise(1.0).alias("recall"), "covered", "total_true", "total_candidates",
        (c("total_candidates") / c("parents")).alias("mean_candidates"), place(F.floor(c("parents") / 2)).alias("median_candidates"), place(p95).alias("p95_candidates"), c("most").alias("max_candidates"),
        (1 - c("total_candidates") / (c("parents") * F.lit(float(n_targets)))).alias("reduction_ratio"),
    )


def missed_pairs(truth_pairs: DataFrame, candidate_pairs: DataFrame) -> DataFrame:
    """True pairs (s1_id, cand_id) that no candidate covers."""
    return truth_pairs.join(candidate_pairs, ["s1_id", "cand_id"], "left_anti")


def recall_curve(cands: DataFrame, truth_pairs: DataFrame, ranks: tuple[int, ...] = (1, 2, 3, 5, 8, 12)) -> DataFrame:
    """For each rank k: pairs up to it, true pairs among them, recall. cands: (s1_id, cand_id, rank)."""
    total = truth_pairs.count()
    marked = cands.join(truth_pairs.withColumn("_true", F.lit(1)), ["s1_id", "cand_id"], "left")
    per = marked.groupBy("rank").agg(F.count("*").alias("n"), F.count("_true").alias("hits"))
    sums = per.agg(*(F.sum(F.when(F.col("rank") <= k, F.col(x)).otherwise(0)).alias(f"{x}{k}") for k in ranks for x in ("n", "hits")))
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("pairs"), F.col(f"hits{k}").alias("hits")) for k in ranks))
    return sums.select(F.explode(rows).alias("r")).select("r.k", "r.pairs", "r.hits", F.round(F.col("r.hits") / F.lit(max(1, total)), 6).alias("recall"))


def relative_recall(cands: DataFrame, truth_pairs: DataFrame, grid: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """For each cut: pairs whose score reaches so much of their query's best, true pairs among them, recall. cands: (s1_id, cand_id, score, gap_top)."""
    total = truth_pairs.count()
    marked = cands.join(truth_pairs.withColumn("_true", F.lit(1)), ["s1_id", "cand_id"], "left")
    reach = lambda cut: F.col("score") >= F.lit(cut) * (F.col("score") + F.col("gap_top"))
    sums = marked.agg(*(f for i, cut in enumerate(grid) for f in (F.count_if(reach(cut)).alias(f"n{i}"), F.count_if(reach(cut) & F.col("_true").isNotNull()).alias(f"h{i}"))))
    rows = F.array(*(F.struct(F.lit(cut).alias("cut"), F.col(f"n{i}").alias("pairs"), F.col(f"h{i}").alias("hits")) for i, cut in enumerate(grid)))
    return sums.select(F.explode(rows).alias("r")).select("r.cut", "r.pairs", "r.hits", F.round(F.col("r.hits") / F.lit(max(1, total)), 6).alias("recall"))


def label_means(cands: DataFrame, truth_pairs: DataFrame, columns: tuple[str, ...] = ("ncos", "acos")) -> DataFrame:
    """(label, n, mean of each column) of true and other pairs."""
    marked = cands.join(truth_pairs.withColumn("label", F.lit(1)), ["s1_id", "cand_id"], "left").fillna({"label": 0})
    return marked.groupBy("label").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in columns))


# Profiles and checks.


def source_profile(records: DataFrame) -> DataFrame:
    """One row of counts: records, empty fields, distinct names and addresses, mean words."""
    blank = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) == "")
    low = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.lower(F.trim(F.col(c))))
    words = lambda c: F.sum(f"_{c}") / F.count("*")
    counted = records.withColumns({f"_{c}": F.size(words_of(normalize_text(F.col(c)))) for c in ("business_name", "business_address")})
    return counted.agg(
        F.count("*").alias("total"), blank("business_name").alias("empty_names"), blank("business_address").alias("empty_addresses"), blank("country").alias("empty_countries"),
        F.countDistinct(low("business_name")).alias("distinct_names"), F.countDistinct(low("business_address")).alias("distinct_addresses"),
        F.round(words("business_name"), 6).alias("mean_name_words"), F.round(words("business_address"), 6).alias("mean_address_words"),
    )


def country_histogram(records: DataFrame) -> DataFrame:
    return records.select(normalize_country(F.col("country")).alias("country")).groupBy("country").agg(F.count("*").alias("n"))


def truth_profile(truth: DataFrame) -> DataFrame:
    """One row for each number of matches: parents, and all pairs and singletons beside."""
    per = truth.groupBy(F.size("ids").alias("matches")).agg(F.count("*").alias("parents"))
    return per.withColumn("pairs", F.col("matches") * F.col("parents"))


def id_is_valid(entity_id: Column, prefix: str | None = None) -> Column:
    """A known prefix (or the given one) and something after it."""
    return F.coalesce(entity_id.rlike(f"^{prefix}" if prefix else r"^S[123]-") & (F.trim(F.regexp_extract(entity_id, "(?s)^[^-]*-(.*)$", 1)) != ""), F.lit(False))


def integrity_report(records: DataFrame, prefix: str | None = None, most: int = 10) -> DataFrame:
    """One row: total, duplicates beyond the first, malformed ids, their first few, empty fields, is_valid."""
    per = records.groupBy("entity_id").agg(F.count("*").alias("n"))
    few = lambda when: F.slice(F.array_sort(F.collect_list(when)), 1, most)
    # Offenders are ranked by the aggregation's own order and cut: at most ``most`` ids come together.
    duplicates = per.where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))
    first_duplicates = per.where("n > 1").select("entity_id").orderBy("entity_id").limit(most).agg(few(F.col("entity_id")).alias("duplicate_ids"))
    bad = records.where(~id_is_valid(F.col("entity_id"), prefix))
    first_bad = bad.select("entity_id").orderBy("entity_id").limit(most).agg(few(F.col("entity_id")).alias("malformed_ids"))
    blank = lambda c: F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    totals = records.agg(F.count("*").alias("total"), F.count_if(~id_is_valid(F.col("entity_id"), prefix)).alias("n_malformed"), blank("business_name").alias("empty_names"), blank("business_address").alias("empty_addresses"), blank("country").alias("empty_countries"))
    one = totals
    for other in (duplicates, first_duplicates, first_bad):  # one row each
        one = one.withColumn("_one", F.lit(1)).join(F.broadcast(other.withColumn("_one", F.lit(1))), "_one").drop("_one")
    return one.withColumn("is_valid", (F.col("n_duplicates") == 0) & (F.col("n_malformed") == 0))


def _finding(rule: str, offenders: DataFrame, column: str, most: int = 5) -> DataFrame:
    ids = offenders.select(F.col(column).alias("id")).distinct()
    first = ids.orderBy("id").limit(most).agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("examples")).withColumn("_one", F.lit(1))
    return ids.agg(F.count("*").alias("offenders")).withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one").select(F.lit(rule).alias("rule"), "offenders", "examples")


def submission_findings(rows: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """A row for each rule: how many offend, and the first few.

    rows: (s1_id, list) as written, ids comma-joined; required: s1_id; known: entity ids that may be matched;
    candidates: (s1_id, list). matched_outside_candidates is a warning, the rest are errors.
    """
    split = lambda df: df.select("s1_id", F.filter(F.split(F.coalesce("list", F.lit("")), ","), lambda x: F.trim(x) != "").alias("ids"))
    lists = split(rows)
    ids = lists.select("s1_id", F.explode(F.array_distinct("ids")).alias("id"))
    found = [
        _finding("duplicate_rows", lists.groupBy("s1_id").count().where("count > 1"), "s1_id"),
        _finding("repeated_ids", lists.where(F.size("ids") > F.size(F.array_distinct("ids"))), "s1_id"),
        _finding("self_matches", ids.where(F.col("id").startswith("S1-")), "id"),
        _finding("wrong_prefix", ids.where(~F.col("id").rlike("^S[123]-")), "id"),
        _finding("missing_parents", required.select("s1_id").join(lists.select("s1_id"), "s1_id", "left_anti"), "s1_id"),
        _finding("extra_parents", lists.select("s1_id").join(required.select("s1_id"), "s1_id", "left_anti"), "s1_id"),
    ]
    if known is not None:
        found.append(_finding("unknown_ids", ids.where(F.col("id").rlike("^S[23]-")).join(known.select(F.col("entity_id").alias("id")), "id", "left_anti"), "id"))
    if candidates is not None:
        held = split(candidates).select("s1_id", F.explode("ids").alias("id"))
        found.append(_finding("matched_outside_candidates", ids.join(held, ["s1_id", "id"], "left_anti"), "s1_id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def header_is(df: DataFrame, expected: list[str]) -> bool:
    """Whether a file's columns are exactly these, trimmed and in lower case."""
    return [c.strip().lower() for c in df.columns] == expected
