"""Features of candidate pairs.

Each function takes pairs whose two sides stand under prefixes ``l_`` and ``r_`` (see ``with_sides``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import similarity as sim
from linkloom.functions.text import char_ngrams, words_of

SIDE = ["business_name", "business_address", "name_stripped", "addr_norm", "country_norm"]


def with_sides(pairs: DataFrame, left: DataFrame, right: DataFrame, columns: list[str], keep: list[str] | None = None, l_more: list[str] = [], r_more: list[str] = []) -> DataFrame:
    """pairs (s1_id, cand_id, ...) with columns of both records: l_* by s1_id, r_* by cand_id; each side may have more of its own."""
    own = {"l_": [*columns, *l_more], "r_": [*columns, *r_more]}
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), *(F.col(c).alias(p + c) for c in own[p]))
    # s1_id comes last: what ranks a record's candidates finds them in place.
    out = pairs.join(side(right, "cand_id", "r_"), "cand_id").join(side(left, "s1_id", "l_"), "s1_id")
    return out.select(*(keep or pairs.columns), *(p + c for p, names in own.items() for c in names))


def _padded(words: Column) -> Column:
    return F.transform(F.array_distinct(words), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def left_sets(p: str = "") -> dict[str, Column]:
    """What pairs look up of a left record in the right one's texts: words and numbers between blanks, and 3-grams, each once."""
    name, addr = F.col(f"{p}name_stripped"), F.col(f"{p}addr_norm")
    return {
        f"{p}name_words": _padded(words_of(name)), f"{p}name_grams": F.array_distinct(char_ngrams(name, 3)),
        f"{p}addr_words": _padded(words_of(addr)), f"{p}addr_grams": F.array_distinct(char_ngrams(addr, 3)), f"{p}addr_nums": _padded(sim.numbers_in(addr)),
    }


def right_sizes(p: str = "") -> dict[str, Column]:
    """The sizes of a right record's sets, and its numbers between blanks."""
    name, addr = F.col(f"{p}name_stripped"), F.col(f"{p}addr_norm")
    size = lambda items: F.size(F.array_distinct(items))
    return {
        f"{p}name_words_n": size(words_of(name)), f"{p}name_grams_n": size(char_ngrams(name, 3)), f"{p}addr_words_n": size(words_of(addr)), f"{p}addr_grams_n": size(char_ngrams(addr, 3)),
        f"{p}addr_nums_n": size(sim.numbers_in(addr)), f"{p}addr_numbers": F.concat(F.lit(" "), F.array_join(sim.numbers_in(addr), " "), F.lit(" ")),
    }


def compared_sides(pairs: DataFrame, left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """``with_sides`` for the native features: their sets are made once for each record, not for each pair."""
    return with_sides(pairs, left.withColumns(left_sets()), right.withColumns(right_sizes()), columns, l_more=list(left_sets()), r_more=list(right_sizes()))


NATIVE = [
    "name_raw_exact", "name_norm_exact", "name_token_jaccard", "name_token_containment", "name_levenshtein", "name_char_3gram", "name_length_ratio", "name_shared_tokens",
    "addr_norm_exact", "addr_token_jaccard", "addr_levenshtein", "addr_char_3gram", "addr_num_overlap", "addr_shared_nums", "addr_length_ratio", "country_match", "postal_code_match",
]
FEATURES = [
    "name_raw_exact", "name_norm_exact", "name_token_jaccard", "name_token_containment", "name_levenshtein", "name_jaro_winkler", "name_char_3gram", "name_length_ratio", "name_shared_tokens",
    "addr_norm_exact", "addr_token_jaccard", "addr_levenshtein", "addr_char_3gram", "addr_num_overlap", "addr_shared_nums", "addr_length_ratio", "country_match", "postal_code_match",
    "combined_geom_sim", "strong_agreement", "strong_disagreement",
]


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def native_features(pairs: DataFrame) -> DataFrame:
    """Adds the features that need no UDF (NATIVE).

    A word or 3-gram of the left is in the right's set just if the right's text holds it (a word between blanks), so no set of the
    right is made, only its size. Sides without these sets (see ``compared_sides``) get them here, for each pair.
    """
    c = F.col
    sets = {} if "l_name_grams" in pairs.columns else left_sets("l_") | right_sizes("r_")
    ln, rn, la, ra = c("l_name_stripped"), c("r_name_stripped"), c("l_addr_norm"), c("r_addr_norm")
    held = lambda items, text: F.when(text.isNotNull(), F.size(F.filter(items, lambda t: F.contains(text, t))))
    spaced = lambda text: F.concat(F.lit(" "), text, F.lit(" "))
    shared = {
        "_name_words": held("l_name_words", spaced(rn)), "_name_grams": held("l_name_grams", rn), "_addr_words": held("l_addr_words", spaced(ra)),
        "_addr_grams": held("l_addr_grams", ra), "_addr_nums": held("l_addr_nums", c("r_addr_numbers")),
    }
    jaccard = lambda name: sim.ratio_or(c(f"_{name}"), F.size(f"l_{name}") + c(f"r_{name}_n") - c(f"_{name}"), 1.0)
    grams = lambda name, a, b: F.when((F.length(a) < 3) | (F.length(b) < 3), (a == b).cast("double")).otherwise(jaccard(name))
    return pairs.withColumns(sets).withColumns(shared).withColumns({
        "name_raw_exact": flag((c("l_business_name") == c("r_business_name")) & (c("l_business_name") != "")),
        "name_norm_exact": flag((ln == rn) & (ln != "")),
        "name_token_jaccard": jaccard("name_words"), "name_token_containment": sim.ratio_or(c("_name_words"), F.least(F.size("l_name_words"), c("r_name_words_n")), 0.0), "name_levenshtein": sim.levenshtein_ratio(ln, rn),
        "name_char_3gram": grams("name_grams", ln, rn), "name_length_ratio": sim.length_ratio(ln, rn), "name_shared_tokens": c("_name_words").cast("double"),
        "addr_norm_exact": flag((la == ra) & (la != "")),
        "addr_token_jaccard": jaccard("addr_words"), "addr_levenshtein": sim.levenshtein_ratio(la, ra), "addr_char_3gram": grams("addr_grams", la, ra),
        "addr_num_overlap": jaccard("addr_nums"), "addr_shared_nums": c("_addr_nums").cast("double"), "addr_length_ratio": sim.length_ratio(la, ra),
        "country_match": flag((c("l_country_norm") == c("r_country_norm")) & (c("l_country_norm") != "UNKNOWN")),
        "postal_code_match": flag(F.exists("l_addr_nums", lambda n: F.length(n).isin(7, 8) & F.contains(c("r_addr_numbers"), n))),
    }).drop(*shared, *left_sets("l_"), *right_sizes("r_"))


def pair_features(pairs: DataFrame) -> DataFrame:
    """Adds all 21 features (FEATURES)."""
    c = F.col
    df = native_features(pairs).withColumn("name_jaro_winkler", sim.jaro_winkler_similarity(c("l_name_stripped"), c("r_name_stripped")))
    name = (c("name_token_jaccard") + c("name_levenshtein") + c("name_char_3gram") + c("name_jaro_winkler")) / 4
    addr = (c("addr_token_jaccard") + c("addr_levenshtein") + c("addr_char_3gram")) / 3
    df = df.withColumns({"_name": name, "_addr": addr})
    return df.withColumns({
        "combined_geom_sim": F.sqrt(c("_name") * c("_addr")),
        "strong_agreement": flag((c("_name") > 0.85) & (c("_addr") > 0.7) & (c("country_match") == 1)),
        "strong_disagreement": flag((c("_name") < 0.25) | (c("country_match") == 0)),
    }).drop("_name", "_addr")


def rule_score(name_weight: float = 0.55, addr_weight: float = 0.35, boost: float = 0.1, agreement: Column | None = None) -> Column:
    """Score in [0, 1] from the native features; agreement adds the boost."""
    c = F.col
    name = c("name_token_jaccard") * 0.4 + c("name_levenshtein") * 0.3 + c("name_char_3gram") * 0.3
    addr = c("addr_token_jaccard") * 0.4 + c("addr_levenshtein") * 0.3 + c("addr_num_overlap") * 0.3
    score = name_weight * name + addr_weight * addr
    if agreement is not None:
        score = score + F.when(agreement, F.lit(boost)).otherwise(0.0)
    exact = (c("name_norm_exact") == 1) & (c("addr_norm_exact") == 1)
    return F.when(c("country_match") == 0, 0.0).when(exact, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


FAST_SIDE = ["fast_name", "name_words", "name_grams", "fast_addr", "addr_words", "addr_nums", "postal", "country_code"]
FAST_FEATURES = [
    "name_exact", "name_tok_jac", "name_tok_con", "name_char_jac", "name_len_ratio", "addr_exact", "addr_tok_jac", "addr_num_jac", "addr_shared_nums", "addr_len_ratio",
    "postal_match", "country_match", "combined", "agreement", "disagreement",
]


def _same(name: str) -> Column:
    return flag((F.col(f"l_{name}") == F.col(f"r_{name}")) & (F.col(f"l_{name}") != ""))


def _fast_jaccard(name: str) -> Column:
    return sim.jaccard(F.col(f"l_{name}"), F.col(f"r_{name}"), empty=0.0)


CODES = ["name_code", "addr_code", "word_codes", "gram_codes", "addr_codes", "postal", "country_code"]


def fast_codes(records: DataFrame) -> DataFrame:
    """Adds what the cheap score reads: texts and the sets of words and n-grams as 64-bit hashes, 0 for ''."""
    code = lambda name: F.when(F.col(name) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(name))
    codes = lambda name: F.transform(F.array_distinct(name), lambda t: F.xxhash64(t))
    return records.withColumns({"name_code": code("fast_name"), "addr_code": code("fast_addr"), "word_codes": codes("name_words"), "gram_codes": codes("name_grams"), "addr_codes": codes("addr_words")})


SIGNED = {"word_codes": 2, "gram_codes": 4, "addr_codes": 2}  # sets with signatures of so many longs
SIGNS = ["name_code", "addr_code", "postal", "country_code", *(f"{name}_{k}" for name, lanes in SIGNED.items() for k in ("n", *range(lanes)))]


def with_signatures(coded: DataFrame) -> DataFrame:
    """Adds of each set of codes its size and a signature: every code sets one of its bits (SIGNS, with the scalars)."""
    def lane(name: str, k: int, lanes: int) -> Column:
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
        own = F.filter(name, lambda c: F.pmod(F.call_function("shiftrightunsigned", c, F.lit(6)), F.lit(lanes)) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(bit(c)))

    signs = {f"{name}_{k}": lane(name, k, lanes) for name, lanes in SIGNED.items() for k in range(lanes)}
    return coded.withColumns({f"{name}_n": F.size(name) for name in SIGNED} | signs)


def _cheap(jaccard) -> Column:
    equal = lambda name, none: flag((F.col(f"l_{name}") == F.col(f"r_{name}")) & (F.col(f"l_{name}") != none))
    return equal("name_code", 0) + jaccard("word_codes") + jaccard("gram_codes") + equal("addr_code", 0) + 0.5 * jaccard("addr_codes") + 0.3 * equal("postal", 0) + 0.2 * equal("country_code", "")


def cheap_score() -> Column:
    """A quick score to rank a record's candidates by, on the codes of words and n-grams (see fast_codes)."""
    def jaccard(name: str) -> Column:
        left, right = F.col(f"l_{name}"), F.col(f"r_{name}")
        both = F.size(F.array_intersect(left, right))
        return sim.ratio_or(both, F.size(left) + F.size(right) - both, 0.0)

    return _cheap(jaccard)


def cheap_bound() -> Column:
    """Not less than the cheap score, from signatures: a bit that only one side has stands for a code that only it has."""
    def jaccard(name: str) -> Column:
        left, right = F.col(f"l_{name}_n"), F.col(f"r_{name}_n")
        lanes = [(F.col(f"l_{name}_{k}"), F.col(f"r_{name}_{k}")) for k in range(SIGNED[name])]
        alone = lambda sides: sum((F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in sides), F.lit(0))
        both = F.least(left - alone(lanes), right - alone([(y, x) for x, y in lanes]))
        return sim.ratio_or(both, left + right - both, 0.0)

    return _cheap(jaccard)


def fast_features(pairs: DataFrame) -> DataFrame:
    """Adds the 15 fast features; nothing over nothing is 0 here."""
    c = F.col
    size = lambda a: F.size(F.array_distinct(c(a)))
    lengths = lambda n: sim.ratio_or(F.least(F.length(f"l_{n}"), F.length(f"r_{n}")), F.greatest(F.length(f"l_{n}"), F.length(f"r_{n}")), 0.0)
    df = pairs.withColumns({
        "name_exact": _same("fast_name"), "name_tok_jac": _fast_jaccard("name_words"),
        "name_tok_con": sim.ratio_or(F.size(F.array_intersect("l_name_words", "r_name_words")), F.least(size("l_name_words"), size("r_name_words")), 0.0),
        "name_char_jac": _fast_jaccard("name_grams"), "name_len_ratio": lengths("fast_name"),
        "addr_exact": _same("fast_addr"), "addr_tok_jac": _fast_jaccard("addr_words"), "addr_num_jac": _fast_jaccard("addr_nums"),
        "addr_shared_nums": F.size(F.array_intersect("l_addr_nums", "r_addr_nums")).cast("double"), "addr_len_ratio": lengths("fast_addr"),
        "postal_match": flag((c("l_postal") != 0) & (c("l_postal") == c("r_postal"))), "country_match": _same("country_code"),
    })
    df = df.withColumns({"_name": (c("name_tok_jac") + c("name_char_jac")) / 2, "_addr": (c("addr_tok_jac") + c("addr_num_jac")) / 2})
    return df.withColumns({
        "combined": F.sqrt(c("_name") * c("_addr")), "agreement": flag((c("_name") > 0.85) & (c("_addr") > 0.7) & (c("country_match") == 1)),
        "disagreement": flag((c("_name") < 0.25) | (c("country_match") == 0)),
    }).drop("_name", "_addr")


FORMS = ["n_norm", "n_core", "n_compact", "n_skel", "n_domain", "n_alt", "n_nonlatin", "a_norm", "a_words", "a_nums", "a_first_num", "a_postal", "a_state", "a_empty"]


def fuzzy_features(pairs: DataFrame) -> DataFrame:
    """Adds the 40 features of the transliterated forms (22 of names, 18 of addresses)."""
    c = F.col
    both = lambda name: (c(f"l_{name}"), c(f"r_{name}"))
    given = lambda name, value: F.when(c(f"r_{name}") == "", F.lit(-1.0)).otherwise(value)
    masked = lambda value: F.when(c("r_a_empty") == 1, F.lit(-1.0)).otherwise(value)
    either = lambda name: F.when((c(f"l_{name}") == "") | (c(f"r_{name}") == ""), -1).otherwise((c(f"l_{name}") == c(f"r_{name}")).cast("int"))
    first = lambda p: F.regexp_extract(c(f"{p}_n_core"), "^([^ ]*)", 1)
    r_extra, l_extra, num_jacc = sim.number_sets(*both("a_nums"))
    count = lambda p: (F.length(c(f"{p}_n_core")) - F.length(F.replace(c(f"{p}_n_core"), F.lit(" "), F.lit(""))) + 1).cast("double")
    ratios = {
        "n_ratio": (sim.indel_ratios, "n_norm"), "n_tset": (sim.token_set_ratios, "n_norm"), "n_tsort": (sim.token_sort_ratios, "n_norm"),
        "c_ratio": (sim.indel_ratios, "n_core"), "c_tset": (sim.token_set_ratios, "n_core"), "c_tsort": (sim.token_sort_ratios, "n_core"),
        "c_partial": (sim.partial_ratios, "n_core"), "c_wratio": (sim.weighted_ratios, "n_core"), "cp_jw": (sim.jaro_winklers, "n_compact"),
        "sk_tset": (sim.token_set_ratios, "n_skel"), "sk_ratio": (sim.indel_ratios, "n_skel"), "first_tok_ratio": (sim.indel_ratios, "_first"),
        "a_tset": (sim.token_set_ratios, "a_norm"), "a_tsort": (sim.token_sort_ratios, "a_norm"), "a_ratio": (sim.indel_ratios, "a_norm"), "a_partial": (sim.partial_token_set_ratios, "a_norm"), "aw_tset": (sim.token_set_ratios, "a_words"),
    }
    ratios = {name: (score, f"l_{form}", f"r_{form}") for name, (score, form) in ratios.items()}
    ratios |= {"dom_ratio": (sim.indel_ratios, "l_n_compact", "r_n_domain"), "dom_partial": (sim.partial_ratios, "l_n_compact", "r_n_domain"), "alt_tset": (sim.token_set_ratios, "l_n_core", "r_n_alt")}
    pairs = pairs.withColumns({"l__first": first("l"), "r__first": first("r")}).withColumn("_ratios", sim.scored_together(ratios))
    ratio = lambda name: c(f"_ratios.{name}")
    plain = ["n_ratio", "n_tset", "n_tsort", "c_ratio", "c_tset", "c_tsort", "c_partial", "c_wratio", "cp_jw", "sk_tset", "sk_ratio", "first_tok_ratio"]
    names = {name: ratio(name) for name in plain} | {
        "cp_lev": F.levenshtein(*both("n_compact")).cast("double"), "dom_ratio": given("n_domain", ratio("dom_ratio")), "dom_partial": given("n_domain", ratio("dom_partial")), "alt_tset": given("n_alt", ratio("alt_tset")),
        "c_overlap": sim.overlap(*both("n_core")), "c_inter": sim.shared_words(*both("n_core")), "l_ntok": count("l"), "r_ntok": count("r"), "r_nonlatin": c("r_n_nonlatin"), "name_num": sim.number_agreement(*both("n_norm")),
    }
    addresses = {name: masked(ratio(name)) for name in ("a_tset", "a_tsort", "a_ratio", "a_partial", "aw_tset")} | {
        "r_addr_empty": c("r_a_empty"), "aw_overlap": masked(sim.overlap(*both("a_words"))), "aw_inter": masked(sim.shared_words(*both("a_words"))),
        "num_overlap": given("a_nums", sim.overlap(*both("a_nums"))), "num_inter": sim.shared_words(*both("a_nums")), "num_r_extra": r_extra, "num_l_extra": l_extra, "num_jacc": num_jacc,
        "first_num_eq": F.when(c("r_a_first_num") == "", -1).otherwise((c("l_a_first_num") == c("r_a_first_num")).cast("int")),
        "first_num_lev": given("a_first_num", F.levenshtein(*both("a_first_num")).cast("double")),
        "first_num_in": ((c("r_a_first_num") != "") & F.array_contains(words_of(c("l_a_nums")), c("r_a_first_num"))).cast("int"),
        "postal_eq": either("a_postal"), "state_eq": either("a_state"),
    }
    return pairs.withColumns(names | addresses).drop("_ratios", "l__first", "r__first")


# Competition among candidates.


def ranked(df: DataFrame, by: list[str], score: str, tie: list[str], prefix: str) -> DataFrame:
    """Adds {prefix}rank, {prefix}top, {prefix}second (0 if alone), {prefix}size of ``score`` within ``by``."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *tie)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({
        f"{prefix}rank": F.row_number().over(order), f"{prefix}top": F.first_value(score).over(whole),
        f"{prefix}second": F.coalesce(F.nth_value(score, 2).over(whole), F.lit(0.0)), f"{prefix}size": F.count(F.lit(1)).over(whole),
    })


QUERY = ["src", "q_id"]


def competition(cands: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds, to candidates (src, q_id, s1_id, score, ncos, acos), how each ranks among its query's and its parent's.

    parts: how many tasks the parents are dealt to, where the session's number of partitions wouldn't grow with the candidates.
    """
    c = F.col
    df = ranked(cands, QUERY, "score", ["s1_id"], "_q")
    df = df.withColumns({
        "rank": F.least(c("_qrank"), F.lit(127)), "gap_top": c("_qtop") - c("score"),
        "margin": F.when(c("_qrank") == 1, c("score") - c("_qsecond")).otherwise(c("score") - c("_qtop")), "n_cand_q": c("_qsize"),
    })
    for name in ("ncos", "acos"):
        df = ranked(df, QUERY, name, ["s1_id"], "_x").withColumns({f"{name}_gap": c("_xtop") - c(name), f"{name}_rank": F.least(c("_xrank"), F.lit(127))})
    df = ranked(df.repartition(parts, "s1_id") if parts else df, ["s1_id"], "score", QUERY, "_s")
    top1 = F.sum((c("_qrank") == 1).cast("int")).over(Window.partitionBy("s1_id"))
    cut = F.lit(32000)
    df = df.withColumns({"rank_s1": F.least(c("_srank"), cut), "gap_top_s1": c("_stop") - c("score"), "n_cand_s1": F.least(c("_ssize"), cut.cast("long")), "n_top1_s1": F.least(top1, cut.cast("long"))})
    return df.drop(*(p + n for p in ("_q", "_x", "_s") for n in ("rank", "top", "second", "size")))


def probability_context(pairs: DataFrame, win: float = 0.5) -> DataFrame:
    """Adds, to pairs (src, q_id, s1_id, p1), what the other pairs' probabilities say."""
    c = F.col
    df = ranked(ranked(pairs, QUERY, "p1", ["s1_id"], "_q"), ["s1_id"], "p1", QUERY, "_s")
    by_query, by_parent = Window.partitionBy(*QUERY), Window.partitionBy("s1_id")
    won = ((c("_qrank") == 1) & (c("p1") >= win)).cast("int")
    df = df.withColumns({
        "p_rank_q": F.least(c("_qrank"), F.lit(127)), "p_other_q": F.when(c("_qrank") == 1, c("_qsecond")).otherwise(c("_qtop")), "p_sum_q": F.sum("p1").over(by_query),
        "p_rank_s1": F.least(c("_srank"), F.lit(1000)), "p_top_s1": c("_stop"), "p_sum_s1": F.sum("p1").over(by_parent) - c("p1"),
        "n_win_s1": F.least(F.sum(won).over(by_parent) - won, F.lit(32000).cast("long")),
    })
    return df.drop(*(p + n for p in ("_q", "_s") for n in ("rank", "top", "second", "size")))
