"""Queries and SQL oracles of the record-linkage and URL operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import pages, text, translit, url
from linkloom.operators import blocking, evaluation, models, pairs, sampling, selection, siblings, tfidf
from linkloom.plans import entities, flows, sql
from linkloom.plans.entities import SCORED_SQL, SOURCES_SQL, TRUTH_SQL, table
from linkloom.sources import io
from linkloom.sources.shared import spool

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name, with its oracle if SQL can express it."""

    def add(run):
        QUERIES[run.__name__] = run
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return add


def joined(*columns: str):
    return [F.array_join(c, ",").alias(c) for c in columns]


# URLs.


def _tokenized(spark, d):
    return url.tokenize(table(spark, d, "pages").select("page_id", "url"))


_PARTS = "page_id, normalized_url, scheme, netloc, domain, tld, port, path, query, fragment, is_ip"


@query(f"WITH {sql.tokenized()} SELECT {_PARTS}, array_to_string(subdomains, ',') AS subdomains, array_to_string(path_tokens, ',') AS path_tokens, array_to_string(query_tokens, ',') AS query_tokens, array_to_string(all_tokens, ',') AS all_tokens FROM tok")
def url_tokenize(spark, d):
    return _tokenized(spark, d).select(*_PARTS.split(", "), *joined("subdomains", "path_tokens", "query_tokens", "all_tokens"))


_FEATURES = [f for f in url.FEATURES if f != "suspicious_tokens"]


@query(f"WITH {sql.tokenized()},{sql.featured()} SELECT page_id, {', '.join(_FEATURES)}, array_to_string(suspicious_tokens, ',') AS suspicious_tokens FROM feat")
def url_features(spark, d):
    return url.features(_tokenized(spark, d)).select("page_id", *_FEATURES, *joined("suspicious_tokens"))


@query(f"WITH {sql.tokenized()} SELECT page_id, {sql.url_entropy('normalized_url')} AS url_entropy, {sql.url_entropy('full_domain')} AS domain_entropy FROM tok")
def url_entropy(spark, d):
    return _tokenized(spark, d).select("page_id", url.entropy(F.col("normalized_url")).alias("url_entropy"), url.entropy(url.full_domain()).alias("domain_entropy"))


@query(f"WITH {sql.tokenized()},{sql.featured()},{sql.threats()} SELECT page_id, heuristic_score, risk_level FROM risk")
def url_heuristic_threat(spark, d):
    return url.heuristics(url.features(_tokenized(spark, d))).select("page_id", "heuristic_score", url.risk_level(F.col("heuristic_score")).alias("risk_level"))


@query(f"WITH {sql.tokenized()},{sql.featured()},{sql.threats()} SELECT risk_level, count(*) AS pages FROM risk GROUP BY risk_level")
def url_risk_counts(spark, d):
    return url_heuristic_threat(spark, d).groupBy("risk_level").agg(F.count("*").alias("pages"))


@query(f"WITH {sql.tokenized()},{sql.reputations()} SELECT page_id, full_domain, reputation_score, reputation_tier, category FROM rep")
def domain_reputation(spark, d):
    return url.reputation(_tokenized(spark, d)).select("page_id", "full_domain", "reputation_score", "reputation_tier", "category")


@query(f"WITH {sql.tokenized()},{sql.reputations()} SELECT category, reputation_tier, count(*) AS pages, CAST(sum(reputation_score) AS BIGINT) AS total_score FROM rep GROUP BY category, reputation_tier")
def category_histogram(spark, d):
    return url.reputation(_tokenized(spark, d)).groupBy("category", "reputation_tier").agg(F.count("*").alias("pages"), F.sum("reputation_score").alias("total_score"))


@query(f"WITH {sql.tokenized()},{sql.featured()},{sql.threats()} SELECT page_id, heuristic_score AS threat_score, heuristic_score >= 0.5 AS is_malicious, greatest(0.5, round(abs(heuristic_score - 0.5) * 2, 4)) AS confidence FROM risk")
def url_assessment(spark, d):
    scored = url.heuristics(url.features(_tokenized(spark, d))).withColumn("model_score", F.lit(0.0))
    return url.assess(scored).select("page_id", "threat_score", "is_malicious", "confidence")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE length(trim(coalesce(url, ''))) >= 3) AS processed, count(*) FILTER (WHERE length(trim(coalesce(url, ''))) < 3) AS failed FROM pages")
def url_batch_summary(spark, d):
    return url.batch_summary(url.analyze(table(spark, d, "pages").select("page_id", "url")))


_ANALYSED = {
    "features": ["url_length", "url_entropy", "subdomain_count", "is_ip", "suspicious_token_count"],
    "threat": ["threat_score", "is_malicious", "risk_level", "confidence"],
    "reputation": ["full_domain", "reputation_score", "reputation_tier", "category"],
}


@query(f"""WITH {sql.tokenized()},{sql.featured()},{sql.threats()},{sql.reputations()}, a AS (SELECT r.*, heuristic_score AS threat_score, heuristic_score >= 0.5 AS is_malicious, greatest(0.5, round(abs(heuristic_score - 0.5) * 2, 4)) AS confidence, reputation_score, reputation_tier, category, length(trim(coalesce(r.url, ''))) >= 3 AS ok FROM risk r JOIN rep USING (page_id))
SELECT page_id, ok AS is_valid, CASE WHEN NOT ok THEN 'URL is empty or too short' END AS error, {', '.join(f'CASE WHEN ok THEN {c} END AS {c}' for own in _ANALYSED.values() for c in own)} FROM a""")
def url_analysis(spark, d):
    """The whole analysis of every URL."""
    found = url.analyze(table(spark, d, "pages").select("page_id", "url"))
    return found.select("page_id", "is_valid", "error", *(f"{part}.{c}" for part, own in _ANALYSED.items() for c in own))


@query(r"SELECT page_id, nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si')), '') AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", pages.native_title(F.col("html")).alias("title"))


@query()
def page_metadata(spark, d):
    return pages.enrich(table(spark, d, "pages")).select("page_id", "title", "description", "favicon_url", "error")


@query()
def url_model_scores(spark, d):
    """The forest's scores joined with the heuristics."""
    return models.url_predictions(models.url_model(spark), table(spark, d, "pages").select("page_id", "url")).select("page_id", "model_score", "heuristic_score", "threat_score", "is_malicious", "risk_level")


_SCHEME = r"lower(regexp_extract(trim(coalesce(url, '')), '^([a-zA-Z][a-zA-Z0-9+\-.]*):', 1))"


@query(f"SELECT page_id, CASE WHEN {_SCHEME} IN ('javascript', 'data', 'file', 'ftp', 'mailto') THEN concat('Unsupported scheme: ', {_SCHEME}) WHEN {_SCHEME} NOT IN ('', 'http', 'https') THEN concat('Non-HTTP scheme: ', {_SCHEME}) END AS error FROM pages")
def url_scheme_check(spark, d):
    return table(spark, d, "pages").select("page_id", url.scheme_error(F.col("url")).alias("error"))


# Normalisation.


def _normalized(spark, d):
    return text.normalized_records(entities.all_records(spark, d))


@query(f"WITH {SOURCES_SQL},{sql.normalized('records')} SELECT entity_id, name_norm, name_stripped, name_compact, array_to_string(name_tokens, ' ') AS name_tokens FROM norm")
def normalize_names(spark, d):
    return _normalized(spark, d).select("entity_id", "name_norm", "name_stripped", "name_compact", F.array_join("name_tokens", " ").alias("name_tokens"))


@query(f"WITH {SOURCES_SQL},{sql.normalized('records')} SELECT entity_id, addr_norm, addr_compact, array_to_string(addr_tokens, ' ') AS addr_tokens FROM norm")
def normalize_addresses(spark, d):
    return _normalized(spark, d).select("entity_id", "addr_norm", "addr_compact", F.array_join("addr_tokens", " ").alias("addr_tokens"))


@query(f"WITH {SOURCES_SQL},{sql.normalized('records')} SELECT entity_id, country, country_norm FROM norm")
def normalize_countries(spark, d):
    return _normalized(spark, d).select("entity_id", "country", "country_norm")


@query(f"SELECT doc_id, length(t) AS chars, md5(t) AS hash FROM (SELECT doc_id, {sql.norm_text(chr(39) + 'x' + chr(39) + ' || source || ' + chr(39) + ' - ' + chr(39) + ' || coalesce(lang, ' + chr(39) + chr(39) + ')')} AS t FROM documents)")
def normalize_labels(spark, d):
    """Text normalisation over the documents' source labels."""
    t = text.normalize_text(F.concat(F.lit("x"), "source", F.lit(" - "), F.coalesce("lang", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("hash"))


_FAST_TEXT = "trim(regexp_replace(translate(lower(coalesce({0}, '')), {1}, {2}), '\\s+', ' ', 'g'))"
_PUNCT = "'" + text.PUNCTUATION.replace("'", "''") + "'"
_BLANKS = "'" + " " * len(text.PUNCTUATION) + "'"


def _fast_sql() -> str:
    t = lambda x: _FAST_TEXT.format(x, _PUNCT, _BLANKS)
    return f"""
fa AS (SELECT *, {sql.canonical(t('business_name'), sql.NAME_MAP)} AS ws, {sql.canonical(t('business_address'), text.ADDRESS_WORDS)} AS addr_words, {sql.case(f"upper({t('country')})", text.COUNTRIES)} AS country_code FROM records),
fb AS (SELECT *, regexp_replace(array_to_string(ws, ' '), '{sql.SUFFIX}', '') AS fast_name, list_filter(ws, lambda w: length(w) >= 2) AS name_words, array_to_string(addr_words, ' ') AS fast_addr, list_filter(addr_words, lambda w: regexp_full_match(w, '[0-9]+')) AS addr_nums FROM fa),
fast AS (SELECT *, coalesce(CAST(list_filter(addr_nums, lambda w: length(w) IN (5, 6))[1] AS BIGINT), 0) AS postal, list_distinct({sql.ngrams("replace(fast_name, ' ', '')", 3)}) AS name_grams FROM fb)"""


@query(f"WITH {SOURCES_SQL},{_fast_sql()} SELECT entity_id, fast_name, array_to_string(name_words, ' ') AS name_words, fast_addr, array_to_string(addr_nums, ' ') AS addr_nums, postal, country_code, len(name_grams) AS n_grams FROM fast")
def fast_normalized(spark, d):
    return text.fast_records(entities.all_records(spark, d)).select("entity_id", "fast_name", F.array_join("name_words", " ").alias("name_words"), "fast_addr", F.array_join("addr_nums", " ").alias("addr_nums"), "postal", "country_code", F.size("name_grams").cast("long").alias("n_grams"))


# Transliterated forms. The derived records are ASCII without acronyms, domains or other names, which SQL covers.

_FOLD = "trim(regexp_replace(lower(regexp_replace({0}, '[''`]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def _skeleton_sql(w: str) -> str:
    x = w
    for a, b in translit.SKELETON_FOLDS:
        x = f"replace({x}, '{a}', '{b}')"
    single = f"array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN i > 1 AND substr({x}, i, 1) = substr({x}, i - 1, 1) THEN '' ELSE substr({x}, i, 1) END), '')"
    return f"CASE WHEN regexp_full_match({w}, '[0-9]+') OR length({w}) < 2 THEN {w} ELSE concat(substr({single}, 1, 1), regexp_replace(substr({single}, 2), '[aeiouy]', '', 'g')) END"


def _numbers_sql(x: str) -> str:
    bare = rf"regexp_replace({x}, '\b(\d+)(st|nd|rd|th|er|e|eme|ieme)\b', '\1', 'g')"
    apart = rf"regexp_replace(regexp_replace({bare}, '([0-9])([a-z])', '\1 \2', 'g'), '([a-z])([0-9])', '\1 \2', 'g')"
    return f"list_transform(list_filter(string_split({apart}, ' '), lambda w: w <> ''), lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN coalesce(nullif(ltrim(w, '0'), ''), '0') ELSE {sql.case('w', translit.ORDINALS)} END)"


def _forms_sql() -> str:
    dropped = sql.quoted(sorted(set(translit.TITLES) | set(translit.LEGAL) | set(translit.LEGAL.values())))
    digit = "regexp_full_match(w, '[0-9]+')"
    comp = _FOLD.format("p")
    state = f"CASE WHEN regexp_full_match(s, '[a-z]{{2}}') AND s NOT IN ('na', 'no') THEN s ELSE CASE s {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in translit.STATE_CODES.items())} END END"
    return f"""
pa AS (SELECT *, list_transform({_numbers_sql(_FOLD.format('business_name'))}, lambda w: {sql.case('w', translit.LEGAL | translit.NAME_WORDS)}) AS canon,
  list_filter(list_transform(string_split(business_address, ','), lambda p: {comp}), lambda s: s <> '') AS comps FROM records),
pb AS (SELECT *, list_filter(canon, lambda w: w NOT IN ({dropped}) AND NOT {digit}) AS core0, list_filter(list_transform(comps, lambda s: {state}), lambda x: x IS NOT NULL) AS states,
  list_filter(list_transform(flatten(list_transform(list_filter(comps, lambda s: ({state}) IS NULL), lambda s: {_numbers_sql('s')})), lambda w: {sql.case('w', translit.ADDRESS)}), lambda w: w <> '') AS outs FROM pa),
pc AS (SELECT *, CASE WHEN len(core0) > 0 THEN core0 WHEN len(list_filter(canon, lambda w: NOT {digit})) > 0 THEN list_filter(canon, lambda w: NOT {digit}) ELSE canon END AS core, list_filter(outs, lambda w: {digit}) AS nums FROM pb),
forms AS (SELECT entity_id, country, array_to_string(canon, ' ') AS n_norm, array_to_string(core, ' ') AS n_core, array_to_string(core, '') AS n_compact, array_to_string(list_transform(core, lambda w: {_skeleton_sql('w')}), ' ') AS n_skel,
  array_to_string(outs, ' ') AS a_norm, array_to_string(list_filter(outs, lambda w: NOT {digit} AND length(w) > 1), ' ') AS a_words, array_to_string(nums, ' ') AS a_nums, coalesce(nums[1], '') AS a_first_num,
  coalesce(list_filter(nums, lambda w: length(w) = 6)[-1], '') AS a_postal, coalesce(states[-1], '') AS a_state, core, outs, canon FROM pc)"""


@query(f"WITH {SOURCES_SQL},{_forms_sql()} SELECT entity_id, n_norm, n_core, n_compact, n_skel FROM forms")
def name_forms(spark, d):
    return translit.name_forms(entities.all_records(spark, d)).select("entity_id", "n_norm", "n_core", "n_compact", "n_skel")


@query(f"WITH {SOURCES_SQL},{_forms_sql()} SELECT entity_id, a_norm, a_words, a_nums, a_first_num, a_postal, a_state FROM forms")
def address_forms(spark, d):
    return translit.address_forms(entities.all_records(spark, d)).select("entity_id", "a_norm", "a_words", "a_nums", "a_first_num", "a_postal", "a_state")


# Blocking.


@query(f"WITH {SOURCES_SQL},{sql.normalized('records')},{sql.keys('norm')} SELECT blocker, count(*) AS n_keys, count(DISTINCT entity_id) AS n_entities, count(DISTINCT key) AS n_distinct FROM keys GROUP BY blocker")
def blocking_key_counts(spark, d):
    keys = blocking.blocking_keys(_normalized(spark, d))
    return keys.groupBy("blocker").agg(F.count("*").alias("n_keys"), F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("key").alias("n_distinct"))


@query(f"WITH {SOURCES_SQL},{sql.normalized('records')},{sql.keys('norm')} SELECT entity_id, blocker, key FROM keys")
def blocking_keys(spark, d):
    return blocking.blocking_keys(_normalized(spark, d))


@query(f"WITH {SOURCES_SQL},{sql.normalized('records')},{sql.keys('norm')} SELECT key, count(*) AS postings FROM keys GROUP BY key")
def key_postings(spark, d):
    return blocking.key_postings(blocking.blocking_keys(_normalized(spark, d)))


@query(f"WITH {SOURCES_SQL},{sql.normalized('records')},{sql.keys('norm')} SELECT entity_id, blocker, key FROM keys WHERE key IN (SELECT key FROM keys GROUP BY key HAVING count(*) <= 500)")
def pruned_keys(spark, d):
    return blocking.pruned_keys(blocking.blocking_keys(_normalized(spark, d)))


def _sides(spark, d):
    s1, s2, s3 = entities.sources(spark, d)
    return spool(text.normalized_records(s1), "normalized"), spool(text.normalized_records(s2.unionByName(s3)), "normalized")


@query(f"WITH {SOURCES_SQL},{sql.candidates()} SELECT s1_id, cand_id, array_to_string(reasons, ',') AS reasons FROM cands")
def candidates_provenance(spark, d):
    left, right = _sides(spark, d)
    return blocking.rule_blocks(left, right).pairs().select("s1_id", "cand_id", F.array_join(blocking.reasons_of(sorted(blocking.BLOCKERS)), ",").alias("reasons"))


@query(f"WITH {SOURCES_SQL},{sql.candidates()} SELECT s1_id, cand_id FROM capped")
def candidates_capped(spark, d):
    return flows.rule_candidates(*_sides(spark, d)).select("s1_id", "cand_id")


@query(f"WITH {SOURCES_SQL},{sql.candidates()} SELECT entity_id AS s1_id, coalesce((SELECT string_agg(cand_id, ',' ORDER BY cand_id) FROM capped c WHERE c.s1_id = s1.entity_id), '') AS candidates FROM s1")
def candidate_lists(spark, d):
    s1, s2, s3 = map(text.normalized_records, entities.sources(spark, d))
    return blocking.generate_candidates(s1, s2, s3).select("s1_id", *joined("candidates"))


# Pairs, scores, matches.


def _native_pairs(spark, d):
    return pairs.native_features(flows.rule_pairs(*_sides(spark, d))[1])


def _round_sql(names, digits=6):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _rounded(names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def _rounded_again(names, digits=6):
    """Of numbers that are rounded already, where halves are common: as DuckDB rounds, the product and not the decimal."""
    return [(F.round(F.col(n) * 10.0**digits) / 10.0**digits).alias(n) for n in names]


@query(f"WITH {SOURCES_SQL},{sql.candidates()},{sql.native_features()} SELECT s1_id, cand_id, {_round_sql(pairs.NATIVE)} FROM pairs")
def pair_features_native(spark, d):
    return _native_pairs(spark, d).select("s1_id", "cand_id", *_rounded(pairs.NATIVE))


@query(f"WITH {SOURCES_SQL},{sql.candidates()},{sql.native_features()},{sql.RULE_SCORED} SELECT s1_id, cand_id, round(score, 6) AS score FROM scored")
def rule_scores(spark, d):
    return _native_pairs(spark, d).select("s1_id", "cand_id", F.round(pairs.rule_score(), 6).alias("score"))


def _matches(spark, d):
    scored = _native_pairs(spark, d).select("s1_id", "cand_id", pairs.rule_score().alias("score"))
    return selection.select_matches(scored, 0.5, 0.15)


@query(f"WITH {SOURCES_SQL},{sql.candidates()},{sql.native_features()},{sql.RULE_SCORED} SELECT s1_id, cand_id, round(score, 6) AS score FROM matches")
def matches_selected(spark, d):
    return _matches(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {SOURCES_SQL},{sql.candidates()},{sql.native_features()},{sql.RULE_SCORED} SELECT entity_id AS source1_entity_id, coalesce(list, '') AS matched_entity_ids FROM s1 LEFT JOIN (SELECT s1_id, string_agg(cand_id, ',' ORDER BY cand_id) AS list FROM matches GROUP BY s1_id) m ON s1_id = entity_id")
def match_lists(spark, d):
    """The output table: every parent with its sorted matches."""
    s1, _, _ = entities.sources(spark, d)
    return io.id_lists(_matches(spark, d), s1.select(F.col("entity_id").alias("s1_id")), io.MATCH_HEADER)


_PER = """
lists AS (SELECT s1_id, list(DISTINCT cand_id) AS p FROM matches GROUP BY s1_id),
per AS (SELECT truth.s1_id, len(ids) AS n_true, len(coalesce(p, [])) AS n_pred, len(list_intersect(ids, coalesce(p, []))) AS tp FROM truth LEFT JOIN lists USING (s1_id)),
ent AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true > 0 AND n_pred > 0 THEN tp / CAST(n_pred AS DOUBLE) ELSE 0.0 END AS pr, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true > 0 AND n_pred > 0 THEN tp / CAST(n_true AS DOUBLE) ELSE 0.0 END AS rc FROM per),
sc AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN pr + rc = 0 THEN 0.0 ELSE 1.25 * pr * rc / (0.25 * pr + rc) END AS f05 FROM ent)"""


@query(f"""WITH {SOURCES_SQL},{TRUTH_SQL},{sql.candidates()},{sql.native_features()},{sql.RULE_SCORED},{_PER}
SELECT round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(f05), 6) AS f05, round(CASE WHEN avg(pr) + avg(rc) = 0 THEN 0.0 ELSE 2 * avg(pr) * avg(rc) / (avg(pr) + avg(rc)) END, 6) AS f1,
  CAST(sum(n_true) AS BIGINT) AS true_pairs, CAST(sum(n_pred) AS BIGINT) AS predicted_pairs, CAST(sum(tp) AS BIGINT) AS true_positives, CAST(sum(n_pred) - sum(tp) AS BIGINT) AS false_positives, CAST(sum(n_true) - sum(tp) AS BIGINT) AS false_negatives,
  count(*) FILTER (WHERE n_true = 0) AS true_singletons, count(*) FILTER (WHERE n_pred = 0) AS predicted_singletons,
  round(CASE WHEN count(*) FILTER (WHERE n_true = 0) > 0 THEN count(*) FILTER (WHERE n_true = 0 AND n_pred = 0) / CAST(count(*) FILTER (WHERE n_true = 0) AS DOUBLE) ELSE 1.0 END, 6) AS singleton_accuracy FROM sc""")
def eval_matching(spark, d):
    df = flows.evaluate(_matches(spark, d), entities.truth(spark, d))
    return df.select(*((F.round(c, 6).alias(c)) if c in ("precision", "recall", "f05", "f1", "singleton_accuracy") else F.col(c) for c in df.columns))


@query(f"""WITH {SOURCES_SQL},{TRUTH_SQL},{sql.candidates()}, lists AS (SELECT s1_id, list(cand_id) AS c FROM capped GROUP BY s1_id),
per AS (SELECT len(ids) AS n_true, len(coalesce(c, [])) AS n, len(list_intersect(ids, coalesce(c, []))) AS covered FROM truth LEFT JOIN lists USING (s1_id)),
o AS (SELECT *, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM per)
SELECT round(sum(covered) / sum(n_true), 6) AS recall, CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(n_true) AS BIGINT) AS total_true, CAST(sum(n) AS BIGINT) AS total_candidates, round(avg(n), 6) AS mean_candidates,
  CAST(max(n) FILTER (WHERE i = m // 2) AS INTEGER) AS median_candidates, CAST(max(n) FILTER (WHERE i = greatest(0, CAST(ceil(0.95 * m) AS BIGINT) - 1)) AS INTEGER) AS p95_candidates, CAST(max(n) AS INTEGER) AS max_candidates,
  round(1 - sum(n) / (count(*) * CAST((SELECT count(*) FROM records WHERE entity_id NOT LIKE 'S1-%') AS DOUBLE)), 6) AS reduction_ratio FROM o""")
def eval_blocking(spark, d):
    left, right = _sides(spark, d)
    df = evaluation.evaluate_blocks(entities.truth(spark, d), flows.rule_blocks(left, right), right.count())
    return df.select(*(F.round(c, 6).alias(c) if c in ("recall", "mean_candidates", "reduction_ratio") else F.col(c) for c in df.columns))


@query(f"WITH {SOURCES_SQL},{TRUTH_SQL},{sql.candidates()} SELECT s1_id, cand_id FROM truth_pairs ANTI JOIN capped USING (s1_id, cand_id)")
def missed_pairs(spark, d):
    left, right = _sides(spark, d)
    true = io.truth_pairs(entities.truth(spark, d))
    return evaluation.missed_pairs(true, flows.rule_blocks(left, right).holding(true))


# The fast flow.


def _fast_keys_sql() -> str:
    parts = {
        "name_exact": ("[fast_name]", "fast_name <> ''"), "name_tokbag": ("[array_to_string(list_sort(list_distinct(name_words)), ' ')]", "len(name_words) > 0"), "postal": ("[CAST(postal AS VARCHAR)]", "postal > 0"),
        "postal_namepfx": ("[concat(postal, '#', name_words[1][1:4])]", "postal > 0 AND len(name_words) > 0"), "addr_exact": ("[fast_addr]", "fast_addr <> ''"),
        "addrnum_namepfx": ("[concat(addr_nums[1], '#', name_words[1][1:3])]", "len(addr_nums) > 0 AND len(name_words) > 0"), "country_addrnum": ("[concat(country_code, '#', addr_nums[1])]", "len(addr_nums) > 0 AND country_code <> ''"),
        "street_tok": ("[list_filter(addr_words, lambda w: length(w) >= 5 AND NOT regexp_full_match(w, '[0-9]+'))[1]]", "len(list_filter(addr_words, lambda w: length(w) >= 5 AND NOT regexp_full_match(w, '[0-9]+'))) > 0"),
    }
    union = " UNION ALL ".join(f"SELECT entity_id, '{k}' AS class, unnest({e}) AS key FROM fast WHERE {w}" for k, (e, w) in parts.items())
    longest = "SELECT entity_id, 'longest_tok' AS class, w AS key FROM (SELECT entity_id, w, row_number() OVER (PARTITION BY entity_id ORDER BY length(w) DESC, i) AS n FROM (SELECT entity_id, w, min(i) AS i FROM (SELECT entity_id, unnest(name_words) AS w, generate_subscripts(name_words, 1) AS i FROM fast) GROUP BY ALL)) WHERE n <= 2 AND length(w) >= 4"
    cap = "CASE class " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in blocking.CLASS_CAPS.items()) + " END"
    return f"""
fkeys AS (SELECT DISTINCT * FROM ({union} UNION ALL {longest})),
fkept AS (SELECT class, key FROM fkeys WHERE entity_id NOT LIKE 'S1-%' GROUP BY class, key HAVING count(*) <= {cap}),
fcands AS (SELECT DISTINCT s.entity_id AS s1_id, t.entity_id AS cand_id FROM fkeys s JOIN fkeys t ON s.class = t.class AND s.key = t.key JOIN fkept k ON k.class = s.class AND k.key = s.key WHERE s.entity_id LIKE 'S1-%' AND t.entity_id NOT LIKE 'S1-%')"""


def _fast_sides(spark, d):
    s1, s2, s3 = entities.sources(spark, d)
    return text.fast_records(s1), text.fast_records(s2.unionByName(s3))


@query(f"WITH {SOURCES_SQL},{_fast_sql()},{_fast_keys_sql()} SELECT entity_id, class, key FROM fkeys")
def fast_keys(spark, d):
    left, right = _fast_sides(spark, d)
    return blocking.fast_keys(left.unionByName(right))


@query(f"WITH {SOURCES_SQL},{_fast_sql()},{_fast_keys_sql()} SELECT s1_id, cand_id FROM fcands")
def fast_candidates(spark, d):
    left, right = _fast_sides(spark, d)
    return blocking.fast_candidates(blocking.fast_keys(left), blocking.fast_keys(right))


def _cheap_sql() -> str:
    j = lambda a: sql.jaccard(f"l.{a}", f"r.{a}", "0.0")
    eq = lambda a: sql.flag(f"l.{a} = r.{a} AND l.{a} <> ''")
    postal = sql.flag("l.postal <> 0 AND l.postal = r.postal")
    return f"""
cheap0 AS (SELECT s1_id, cand_id, round({eq('fast_name')} + {j('name_words')} + {j('name_grams')} + {eq('fast_addr')} + 0.5 * {j('addr_words')} + CAST(0.3 AS DOUBLE) * {postal} + CAST(0.2 AS DOUBLE) * {eq('country_code')}, 9) AS cheap FROM fcands JOIN fast l ON l.entity_id = s1_id JOIN fast r ON r.entity_id = cand_id),
cheap AS (SELECT s1_id, cand_id, cheap FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY cheap DESC, cand_id) AS n FROM cheap0) WHERE n <= 25)"""


@query(f"WITH {SOURCES_SQL},{_fast_sql()},{_fast_keys_sql()},{_cheap_sql()} SELECT s1_id, cand_id, round(cheap, 6) AS cheap FROM cheap")
def cheap_topk(spark, d):
    s1, s2, s3 = entities.sources(spark, d)
    return flows.fast_pairs(s1, s2.unionByName(s3)).select("s1_id", "cand_id", F.round("cheap", 6).alias("cheap"))


def _fast_features_sql() -> str:
    j = lambda a: sql.jaccard(f"l.{a}", f"r.{a}", "0.0")
    eq = lambda a: sql.flag(f"l.{a} = r.{a} AND l.{a} <> ''")
    columns = [
        (eq("fast_name"), "name_exact"), (j("name_words"), "name_tok_jac"), (sql.containment("l.name_words", "r.name_words"), "name_tok_con"), (j("name_grams"), "name_char_jac"), (sql.lengths("l.fast_name", "r.fast_name", "0.0"), "name_len_ratio"),
        (eq("fast_addr"), "addr_exact"), (j("addr_words"), "addr_tok_jac"), (j("addr_nums"), "addr_num_jac"), ("CAST(len(list_intersect(l.addr_nums, r.addr_nums)) AS DOUBLE)", "addr_shared_nums"), (sql.lengths("l.fast_addr", "r.fast_addr", "0.0"), "addr_len_ratio"),
        (sql.flag("l.postal <> 0 AND l.postal = r.postal"), "postal_match"), (eq("country_code"), "country_match"),
    ]
    own = ", ".join(f"{e} AS {n}" for e, n in columns)
    return f"""
ff0 AS (SELECT s1_id, cand_id, {own} FROM cheap JOIN fast l ON l.entity_id = s1_id JOIN fast r ON r.entity_id = cand_id),
ff1 AS (SELECT *, (name_tok_jac + name_char_jac) / 2 AS ns, (addr_tok_jac + addr_num_jac) / 2 AS asim FROM ff0),
ffs AS (SELECT *, sqrt(ns * asim) AS combined, {sql.flag('ns > 0.85 AND asim > 0.7 AND country_match = 1')} AS agreement, {sql.flag('ns < 0.25 OR country_match = 0')} AS disagreement FROM ff1)"""


@query(f"WITH {SOURCES_SQL},{_fast_sql()},{_fast_keys_sql()},{_cheap_sql()},{_fast_features_sql()} SELECT s1_id, cand_id, {_round_sql(pairs.FAST_FEATURES)} FROM ffs")
def fast_features(spark, d):
    s1, s2, s3 = entities.sources(spark, d)
    return flows.fast_pairs(s1, s2.unionByName(s3)).select("s1_id", "cand_id", *_rounded(pairs.FAST_FEATURES))


@query(f"""WITH {SOURCES_SQL},{TRUTH_SQL},{_fast_sql()},{_fast_keys_sql()}
SELECT class, count(*) AS covered, round(count(*) / CAST((SELECT count(*) FROM truth_pairs) AS DOUBLE), 6) AS coverage FROM (SELECT DISTINCT s.class, t.s1_id, t.cand_id FROM truth_pairs t JOIN fkeys s ON s.entity_id = t.s1_id JOIN fkeys c ON c.entity_id = t.cand_id AND c.class = s.class AND c.key = s.key) GROUP BY class""")
def key_coverage(spark, d):
    left, right = _fast_sides(spark, d)
    return blocking.key_coverage(blocking.fast_keys(left), blocking.fast_keys(right), io.truth_pairs(entities.truth(spark, d)))


@query()
def fast_flow_matches(spark, d):
    """Boosted stumps trained on the truth, then the fast flow."""
    s1, s2, s3 = entities.sources(spark, d)
    compared = spool(flows.fast_pairs(s1, s2.unionByName(s3)), "compared")
    model = flows.fit_fast_model(compared, io.truth_pairs(entities.truth(spark, d)))
    return flows.fast_matches(compared, model)


@query()
def logistic_scores(spark, d):
    s1, s2, s3 = entities.sources(spark, d)
    compared = spool(flows.fast_pairs(s1, s2.unionByName(s3)), "compared")
    labelled = compared.join(io.truth_pairs(entities.truth(spark, d)).withColumn("label", F.lit(1)), ["s1_id", "cand_id"], "left").fillna({"label": 0})
    return models.fit_logistic(labelled, pairs.FAST_FEATURES).score(compared).select("s1_id", "cand_id", "score")


# TF-IDF.


def _terms_sql() -> str:
    bi = lambda ws, tag: f"list_transform(range(1, len({ws})), lambda i: '{tag}' || {ws}[i] || '_' || {ws}[i + 1])"
    tag = lambda t, ws: f"list_transform({ws}, lambda w: '{t}' || w)"
    name = [tag("n", "core"), tag("s", "string_split(n_skel, ' ')"), bi("core", "b"), "CASE WHEN length(n_compact) >= 4 THEN ['c' || n_compact] ELSE [] END", tag("#", "list_filter(canon, lambda w: regexp_full_match(w, '[0-9]+'))"), f"CASE WHEN length(n_compact) >= 4 THEN {tag('g', sql.ngrams(chr(39) + '^' + chr(39) + ' || n_compact || ' + chr(39) + '$' + chr(39), 4))} ELSE [] END"]
    addr = [tag("a", "outs"), bi("outs", "p"), "CASE WHEN a_postal <> '' THEN ['z' || a_postal] ELSE [] END", f"list_transform(list_filter(string_split(a_words, ' '), lambda w: length(w) >= 4), lambda w: 'k' || {_skeleton_sql('w')})"]
    union = " UNION ".join(f"SELECT entity_id, country, '{ch}' AS channel, unnest({e}) AS term FROM forms" for ch, own in (("n", name), ("a", addr)) for e in own)
    w = lambda src: f"SELECT t.entity_id, t.country, t.channel, t.term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY t.entity_id, t.channel)) AS w FROM terms t JOIN idf USING (country, channel, term) WHERE t.entity_id {src}"
    return f"""
terms AS MATERIALIZED ({union}),
sizes AS (SELECT country, count(*) AS n FROM s1 GROUP BY country),
idf AS MATERIALIZED (SELECT country, channel, term, ln((any_value(n) + 1) / CAST(count(*) + 1 AS DOUBLE)) + 1 AS idf FROM terms JOIN sizes USING (country) WHERE entity_id LIKE 'S1-%' GROUP BY ALL HAVING count(*) <= 5000),
wq AS MATERIALIZED ({w("NOT LIKE 'S1-%'")}), ws AS MATERIALIZED ({w("LIKE 'S1-%'")}),
cos0 AS MATERIALIZED (SELECT q.entity_id AS q_id, s.entity_id AS s1_id, sum(CASE WHEN channel = 'n' THEN q.w * s.w ELSE 0 END) AS ncos, sum(CASE WHEN channel = 'a' THEN q.w * s.w ELSE 0 END) AS acos FROM wq q JOIN ws s USING (country, channel, term) GROUP BY ALL)"""


_SAME_COUNTRY = "records AS (SELECT entity_id, business_name, business_address, CASE WHEN country IN ('US', 'USA', 'United States') THEN 'US' WHEN country IN ('India', 'IND', 'Bharat') THEN 'INDIA' ELSE 'FRANCE' END AS country FROM"
_TFIDF_SOURCES = SOURCES_SQL.replace("records AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)", f"{_SAME_COUNTRY} (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)),\nsone AS (SELECT * FROM records WHERE entity_id LIKE 'S1-%')")
_COSINES = f"WITH {_TFIDF_SOURCES},{_forms_sql()},{_terms_sql().replace('FROM s1 GROUP', 'FROM sone GROUP')}"


def _prepared(spark, d):
    """Prepared queries and parents, with normalised countries."""
    s1, s2, s3 = (df.withColumn("country", text.normalize_country(F.col("country"))) for df in entities.sources(spark, d))
    return flows.prepared_queries(s2, s3), translit.prepared(s1).withColumn("s1_id", F.col("entity_id"))


@query(f"{_COSINES} SELECT q_id, count(*) AS n_pairs, round(max(0.5 * (ncos + acos)), 6) AS best_score, round(max(acos), 6) AS best_acos, round(sum(ncos), 4) AS total_ncos FROM cos0 GROUP BY q_id")
def tfidf_cosines(spark, d):
    queries, s1 = _prepared(spark, d)
    met = tfidf.cosine_report(queries, s1, ["q_id"])
    return met.select("q_id", "n_pairs", F.round("best_score", 6).alias("best_score"), F.round("best_acos", 6).alias("best_acos"), F.round("total_ncos", 4).alias("total_ncos"))


def _topk_sql() -> str:
    top = lambda score, k: f"SELECT * FROM (SELECT *, max({score}) OVER (PARTITION BY q_id) AS best FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {score} DESC, s1_id) AS n FROM cos1 WHERE {score} >= 0.05) WHERE n <= {k}) WHERE {score} >= CAST(0.4 AS DOUBLE) * best"
    return f"""
cos1 AS MATERIALIZED (SELECT q_id, s1_id, round(0.5 * (ncos + acos), 9) AS score, round(ncos, 9) AS ncos, round(acos, 9) AS acos FROM cos0),
topk AS MATERIALIZED (SELECT DISTINCT CASE WHEN q_id LIKE 'S2-%' THEN 2 ELSE 3 END AS src, q_id, s1_id, score, ncos, acos FROM ({top('score', 12)} UNION ALL {top('acos', 6)}))"""


@query(f"{_COSINES},{_topk_sql()} SELECT src, q_id, s1_id, round(score, 6) AS score, round(ncos, 6) AS ncos, round(acos, 6) AS acos FROM topk")
def tfidf_topk(spark, d):
    """Candidates of every query by both channels."""
    queries, s1 = _prepared(spark, d)
    return tfidf.similarity_join(queries, s1, ["src", "q_id"]).select("src", "q_id", "s1_id", *_rounded_again(["score", "ncos", "acos"]))


@query()
def fuzzy_features(spark, d):
    """The 40 fuzzy features of the pruned candidates."""
    queries, s1 = _prepared(spark, d)
    queries, s1 = spool(queries, "queries"), spool(s1, "parents")
    return flows.featured(flows.block(queries, s1), queries, s1)


# Competition, selection, siblings: over pairs made of line items.

_BY = {"q": "PARTITION BY src, q_id", "s": "PARTITION BY s1_id"}


@query(f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY src, q_id ORDER BY score DESC, s1_id) AS rq, max(score) OVER (PARTITION BY src, q_id) AS tq, count(*) OVER (PARTITION BY src, q_id) AS nq,
  row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, src, q_id) AS rs, max(score) OVER (PARTITION BY s1_id) AS ts, count(*) OVER (PARTITION BY s1_id) AS ns, max(ncos) OVER (PARTITION BY src, q_id) AS tn, row_number() OVER (PARTITION BY src, q_id ORDER BY ncos DESC, s1_id) AS rn,
  max(acos) OVER (PARTITION BY src, q_id) AS ta, row_number() OVER (PARTITION BY src, q_id ORDER BY acos DESC, s1_id) AS ra, coalesce(nth_value(score, 2) OVER (PARTITION BY src, q_id ORDER BY score DESC, s1_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS sq FROM scored)
SELECT src, q_id, s1_id, CAST(least(rq, 127) AS INTEGER) AS rank, round(tq - score, 9) AS gap_top, round(CASE WHEN rq = 1 THEN score - sq ELSE score - tq END, 9) + 0.0 AS margin, nq AS n_cand_q, round(tn - ncos, 9) AS ncos_gap, CAST(least(rn, 127) AS INTEGER) AS ncos_rank,
  round(ta - acos, 9) AS acos_gap, CAST(least(ra, 127) AS INTEGER) AS acos_rank, CAST(least(rs, 32000) AS INTEGER) AS rank_s1, round(ts - score, 9) AS gap_top_s1, least(ns, 32000) AS n_cand_s1, CAST(sum(CASE WHEN rq = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY s1_id) AS BIGINT) AS n_top1_s1 FROM r""")
def competition_features(spark, d):
    df = pairs.competition(entities.scored_pairs(spark, d), entities.pair_parts(spark, d))
    exact = ["gap_top", "margin", "ncos_gap", "acos_gap", "gap_top_s1"]
    return df.select("src", "q_id", "s1_id", *((F.round(c, 9) + 0.0).alias(c) if c in exact else F.col(c) for c in flows.CONTEXT if c not in ("ncos", "acos")))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY src, q_id ORDER BY p DESC, s1_id) AS rq, max(p) OVER (PARTITION BY src, q_id) AS tq, sum(p) OVER (PARTITION BY src, q_id) AS pq,
  coalesce(nth_value(p, 2) OVER (PARTITION BY src, q_id ORDER BY p DESC, s1_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS sq, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, src, q_id) AS rs, max(p) OVER (PARTITION BY s1_id) AS ts, sum(p) OVER (PARTITION BY s1_id) AS ps FROM scored),
w AS (SELECT *, CAST(rq = 1 AND p >= 0.5 AS INTEGER) AS won FROM r)
SELECT src, q_id, s1_id, CAST(least(rq, 127) AS INTEGER) AS p_rank_q, round(CASE WHEN rq = 1 THEN sq ELSE tq END, 6) AS p_other_q, round(pq, 6) AS p_sum_q, CAST(least(rs, 1000) AS INTEGER) AS p_rank_s1, round(ts, 6) AS p_top_s1, round(ps - p, 6) AS p_sum_s1, CAST(sum(won) OVER (PARTITION BY s1_id) - won AS BIGINT) AS n_win_s1 FROM w""")
def probability_context(spark, d):
    df = pairs.probability_context(entities.scored_pairs(spark, d).withColumnRenamed("p", "p1"))
    return df.select("src", "q_id", "s1_id", "p_rank_q", F.round("p_other_q", 6).alias("p_other_q"), F.round("p_sum_q", 6).alias("p_sum_q"), "p_rank_s1", F.round("p_top_s1", 6).alias("p_top_s1"), F.round("p_sum_s1", 6).alias("p_sum_s1"), "n_win_s1")


_BEST = "best AS (SELECT src, q_id, s1_id, p FROM (SELECT *, row_number() OVER (PARTITION BY src, q_id ORDER BY p DESC, s1_id) AS n FROM scored) WHERE n = 1)"


@query(f"WITH {SCORED_SQL}, {_BEST} SELECT src, q_id, s1_id, round(p, 6) AS p FROM best WHERE p >= 0.3")
def assign_best(spark, d):
    return selection.assign_best(entities.scored_pairs(spark, d), 0.3).select("src", "q_id", "s1_id", F.round("p", 6).alias("p"))


@query(f"""WITH {SCORED_SQL}, {_BEST},
t AS (SELECT *, sum(p) OVER (PARTITION BY s1_id) AS total, exp(sum(ln(1 - least(p, 0.999999))) OVER (PARTITION BY s1_id)) AS none FROM best),
e AS (SELECT *, row_number() OVER o AS k, 1.25 * sum(p) OVER (PARTITION BY s1_id ORDER BY p DESC, src, q_id ROWS UNBOUNDED PRECEDING) / (0.25 * total + row_number() OVER o) AS ef FROM t WHERE p >= 0.05 WINDOW o AS (PARTITION BY s1_id ORDER BY p DESC, src, q_id)),
b AS (SELECT *, max(ef) OVER (PARTITION BY s1_id) AS top FROM e), c AS (SELECT *, min(CASE WHEN ef = top THEN k END) OVER (PARTITION BY s1_id) AS kb FROM b)
SELECT src, q_id, s1_id, k, round(ef, 6) AS ef FROM c WHERE k <= kb AND top > none""")
def expected_f_select(spark, d):
    best = selection.assign_best(entities.scored_pairs(spark, d))
    return selection.expected_f_select(best).select("src", "q_id", "s1_id", F.col("k").cast("long").alias("k"), F.round("ef", 6).alias("ef"))


@query(f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY src, q_id ORDER BY score DESC, s1_id) AS rq, max(score) OVER (PARTITION BY src, q_id) AS tq, row_number() OVER (PARTITION BY src, q_id ORDER BY acos DESC, s1_id) AS ra FROM scored)
SELECT src, q_id, s1_id, round(score, 6) AS score FROM r WHERE (rq <= 8 AND score >= 0.6 * (score + (tq - score))) OR (ra <= 4 AND acos >= 0.4)""")
def prune_candidates(spark, d):
    cands = pairs.competition(entities.scored_pairs(spark, d))
    return selection.prune_candidates(cands).select("src", "q_id", "s1_id", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, src, q_id) AS n FROM scored) SELECT src, q_id, s1_id FROM g WHERE n <= 5")
def top_k_per_group(spark, d):
    return selection.top_k(entities.scored_pairs(spark, d), 5, ["s1_id"], "p", ["src", "q_id"]).select("src", "q_id", "s1_id")


@query(f"WITH {SCORED_SQL}, g AS (SELECT src, q_id, s1_id, p, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, q_id) AS n, max(p) OVER (PARTITION BY s1_id) AS top FROM scored WHERE p >= 0.7) SELECT src, q_id, s1_id, round(p, 6) AS p FROM g WHERE n <= 3 AND p >= greatest(0.7, top - 0.15)")
def calibrated_selection(spark, d):
    return selection.select_matches(entities.scored_pairs(spark, d), 0.7, 0.15, 3, score="p", tie="q_id").select("src", "q_id", "s1_id", F.round("p", 6).alias("p"))


@query("SELECT l_partkey AS part, dense_rank() OVER (ORDER BY l_partkey) - 1 AS code, count(*) AS n FROM lineitem GROUP BY l_partkey")
def dense_codes(spark, d):
    coded = selection.dense_codes(table(spark, d, "lineitem").select(F.col("l_partkey").alias("part")), "part")
    return coded.groupBy("part", F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n"))


_CONF = "conf AS (SELECT src, q_id, s1_id, p FROM (SELECT *, row_number() OVER (PARTITION BY src, q_id ORDER BY p DESC, s1_id) AS n FROM scored) WHERE n = 1 AND p >= 0.5)"


@query(f"""WITH {SCORED_SQL}, {_CONF}, cap AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, src, q_id) AS n FROM conf)
SELECT s.src, s.q_id, s.s1_id, count(*) AS n_sib, round(max(c.p), 6) AS best FROM scored s JOIN cap c ON c.s1_id = s.s1_id AND c.n <= 64 AND (c.src <> s.src OR c.q_id <> s.q_id) GROUP BY ALL""")
def sibling_pairs(spark, d):
    df = siblings.sibling_pairs(entities.scored_pairs(spark, d).withColumnRenamed("p", "p1"), parts=entities.pair_parts(spark, d))
    return df.groupBy("src", "q_id", "s1_id").agg(F.count("*").alias("n_sib"), F.round(F.max("sib_p"), 6).alias("best"))


def _claimed(spark, d):
    """Pairs with truth as probabilities: each target with its parent, and with the parent before it."""
    own = io.truth_pairs(entities.truth(spark, d))
    number = F.regexp_extract("cand_id", "([0-9]+)$", 1).cast("long")
    src = F.when(F.col("cand_id").startswith("S2"), 2).otherwise(3)
    p = F.pmod(number * 37, F.lit(101)) / 100.0
    return own.select(src.alias("src"), F.col("cand_id").alias("q_id"), "s1_id", p.alias("p1"))


_CLAIMED_SQL = f"{TRUTH_SQL}, claimed AS (SELECT CASE WHEN cand_id LIKE 'S2%' THEN 2 ELSE 3 END AS src, cand_id AS q_id, s1_id, (CAST(regexp_extract(cand_id, '([0-9]+)$', 1) AS BIGINT) * 37 % 101) / CAST(100 AS DOUBLE) AS p1 FROM truth_pairs)"


@query(f"""WITH {SOURCES_SQL},{_forms_sql()}, {_CLAIMED_SQL},
recs AS (SELECT CASE WHEN entity_id LIKE 'S2%' THEN 2 ELSE 3 END AS src, entity_id AS q_id, * EXCLUDE (entity_id) FROM forms WHERE entity_id NOT LIKE 'S1-%'),
sure AS (SELECT src, q_id, s1_id FROM claimed WHERE p1 >= 0.5),
st AS (SELECT *, (list_filter(string_split(a_words, ' '), lambda w: length(w) >= 4))[1] AS w1 FROM recs),
sk AS (SELECT *, coalesce({_skeleton_sql('w1')}, '') AS street FROM st),
skeys AS (SELECT src, q_id, country || '|addr|' || a_norm AS key FROM sk WHERE length(a_norm) >= 8 UNION ALL SELECT src, q_id, country || '|name|' || n_core FROM sk WHERE length(n_core) >= 4
  UNION ALL SELECT src, q_id, country || '|skel|' || n_skel FROM sk WHERE length(n_skel) >= 4 UNION ALL SELECT src, q_id, country || '|num|' || a_first_num || '|' || street FROM sk WHERE a_first_num <> '' AND street <> ''),
par AS (SELECT DISTINCT key, s1_id FROM skeys JOIN sure USING (src, q_id)), tell AS (SELECT key FROM par GROUP BY key HAVING count(*) <= 3)
SELECT src, q_id, s1_id, n_keys FROM (SELECT src, q_id, s1_id, count(*) AS n_keys FROM skeys ANTI JOIN sure USING (src, q_id) JOIN par USING (key) JOIN tell USING (key) GROUP BY ALL) ANTI JOIN claimed USING (src, q_id, s1_id)""")
def sibling_expansion(spark, d):
    _, s2, s3 = entities.sources(spark, d)
    return siblings.expand(_claimed(spark, d), flows.prepared_queries(s2, s3))


@query()
def sibling_features(spark, d):
    _, s2, s3 = entities.sources(spark, d)
    return siblings.sibling_features(_claimed(spark, d), flows.prepared_queries(s2, s3))


@query()
def two_stage_matches(spark, d):
    """Both stages of trees, expansion by siblings, and the sets of most expected F0.5."""
    s1, s2, s3 = (df.withColumn("country", text.normalize_country(F.col("country"))) for df in entities.sources(spark, d))
    return flows.final_matches(flows.two_stage(s1, s2, s3, io.truth_pairs(entities.truth(spark, d))))


# Profiles and checks.


@query(rf"""WITH {SOURCES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(business_name, '') = '') AS empty_names, count(*) FILTER (WHERE coalesce(business_address, '') = '') AS empty_addresses, count(*) FILTER (WHERE coalesce(country, '') = '') AS empty_countries,
  count(DISTINCT lower(trim(business_name))) AS distinct_names, count(DISTINCT lower(trim(business_address))) AS distinct_addresses, round(sum(len({sql.words(sql.norm_text('business_name'))})) / CAST(count(*) AS DOUBLE), 6) AS mean_name_words, round(sum(len({sql.words(sql.norm_text('business_address'))})) / CAST(count(*) AS DOUBLE), 6) AS mean_address_words FROM records""")
def source_profile(spark, d):
    return evaluation.source_profile(entities.all_records(spark, d))


@query(f"WITH {SOURCES_SQL} SELECT {sql.COUNTRY} AS country, count(*) AS n FROM records GROUP BY 1")
def country_histogram(spark, d):
    return evaluation.country_histogram(entities.all_records(spark, d))


@query(f"WITH {TRUTH_SQL} SELECT CAST(len(ids) AS INTEGER) AS matches, count(*) AS parents, len(ids) * count(*) AS pairs FROM truth GROUP BY len(ids)")
def truth_profile(spark, d):
    return evaluation.truth_profile(entities.truth(spark, d))


def _flawed(spark, d):
    """All records, with every seventh of S3 twice and ids of S3 that end in 5 malformed."""
    df = entities.all_records(spark, d)
    twice = df.where(F.col("entity_id").startswith("S3-") & (F.pmod(F.regexp_extract("entity_id", "([0-9]+)$", 1).cast("long"), F.lit(7)) == 0))
    bad = df.withColumn("entity_id", F.when(F.col("entity_id").rlike("^S3-.*5$"), F.concat(F.lit("X"), "entity_id")).otherwise(F.col("entity_id")))
    return bad.unionByName(twice)


@query(f"""WITH {SOURCES_SQL}, flawed AS (SELECT CASE WHEN regexp_matches(entity_id, '^S3-.*5$') THEN 'X' || entity_id ELSE entity_id END AS entity_id FROM records UNION ALL SELECT entity_id FROM s3 WHERE CAST(regexp_extract(entity_id, '([0-9]+)$', 1) AS BIGINT) % 7 = 0),
dup AS (SELECT entity_id, count(*) AS n FROM flawed GROUP BY entity_id HAVING count(*) > 1), bad AS (SELECT entity_id FROM flawed WHERE NOT regexp_matches(entity_id, '^S[123]-.'))
SELECT (SELECT count(*) FROM flawed) AS total, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM dup) AS n_duplicates, (SELECT count(*) FROM bad) AS n_malformed,
  (SELECT coalesce(string_agg(entity_id, ',' ORDER BY entity_id), '') FROM (SELECT entity_id FROM dup ORDER BY entity_id LIMIT 10)) AS duplicate_ids, (SELECT coalesce(string_agg(entity_id, ',' ORDER BY entity_id), '') FROM (SELECT entity_id FROM bad ORDER BY entity_id LIMIT 10)) AS malformed_ids,
  (SELECT count(*) FROM dup) = 0 AND (SELECT count(*) FROM bad) = 0 AS is_valid""")
def integrity_report(spark, d):
    df = evaluation.integrity_report(_flawed(spark, d))
    return df.select("total", "n_duplicates", "n_malformed", *joined("duplicate_ids", "malformed_ids"), "is_valid")


def _submission(spark, d):
    """Match lists with flaws: some parents missing, some twice, some lists with wrong or repeated ids."""
    lists = entities.truth(spark, d).select("s1_id", F.array_join("ids", ",").alias("list"), F.regexp_extract("s1_id", "([0-9]+)$", 1).cast("long").alias("k")).where(F.pmod("k", F.lit(53)) != 7)
    k = F.col("k")
    wrong = F.when(F.pmod(k, F.lit(31)) == 0, F.concat(F.lit("S1-"), k)).when(F.pmod(k, F.lit(37)) == 0, F.concat(F.lit("Z-"), k)).when(F.pmod(k, F.lit(41)) == 0, F.lit("S2-1,S2-1")).otherwise(F.col("list"))
    return lists.select("s1_id", wrong.alias("list")).unionByName(lists.where(F.pmod(k, F.lit(97)) == 3).select("s1_id", "list")).unionByName(lists.where(k == 0).select(F.lit("S1-none").alias("s1_id"), "list"))


_FIND = "SELECT '{0}' AS rule, count(*) AS offenders, coalesce((SELECT string_agg(id, ', ' ORDER BY id) FROM (SELECT id FROM f_{0} ORDER BY id LIMIT 5)), '') AS examples FROM f_{0}"
_FINDINGS = {
    "duplicate_rows": "SELECT s1_id AS id FROM lists GROUP BY s1_id HAVING count(*) > 1", "repeated_ids": "SELECT DISTINCT s1_id AS id FROM lists WHERE len(ids) > len(list_distinct(ids))",
    "self_matches": "SELECT DISTINCT id FROM own WHERE id LIKE 'S1-%'", "wrong_prefix": "SELECT DISTINCT id FROM own WHERE NOT regexp_matches(id, '^S[123]-')",
    "missing_parents": "SELECT s1_id AS id FROM truth ANTI JOIN lists USING (s1_id)", "extra_parents": "SELECT DISTINCT s1_id AS id FROM lists ANTI JOIN truth USING (s1_id)",
    "unknown_ids": "SELECT DISTINCT id FROM own WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM records)",
}


@query(f"""WITH {SOURCES_SQL},{TRUTH_SQL}, l0 AS (SELECT s1_id, array_to_string(ids, ',') AS list, CAST(regexp_extract(s1_id, '([0-9]+)$', 1) AS BIGINT) AS k FROM truth WHERE CAST(regexp_extract(s1_id, '([0-9]+)$', 1) AS BIGINT) % 53 <> 7),
l1 AS (SELECT s1_id, CASE WHEN k % 31 = 0 THEN concat('S1-', k) WHEN k % 37 = 0 THEN concat('Z-', k) WHEN k % 41 = 0 THEN 'S2-1,S2-1' ELSE list END AS list FROM l0 UNION ALL SELECT s1_id, list FROM l0 WHERE k % 97 = 3 UNION ALL SELECT 'S1-none', list FROM l0 WHERE k = 0),
lists AS (SELECT s1_id, list_filter(string_split(list, ','), lambda x: trim(x) <> '') AS ids FROM l1), own AS (SELECT DISTINCT s1_id, unnest(ids) AS id FROM lists), {', '.join(f'f_{k} AS ({v})' for k, v in _FINDINGS.items())}
{' UNION ALL '.join(_FIND.format(k) for k in _FINDINGS)}""")
def validator_findings(spark, d):
    records = entities.all_records(spark, d)
    return evaluation.submission_findings(_submission(spark, d), entities.truth(spark, d).select("s1_id"), records.select("entity_id"))


@query(f"WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY src, q_id ORDER BY score DESC, s1_id) AS n FROM scored), t AS (SELECT src, q_id, s1_id FROM scored WHERE p >= 0.8) " + " UNION ALL ".join(
    f"SELECT {k} AS k, count(*) FILTER (WHERE n <= {k}) AS pairs, count(*) FILTER (WHERE n <= {k} AND p >= 0.8) AS hits, round(count(*) FILTER (WHERE n <= {k} AND p >= 0.8) / CAST((SELECT count(*) FROM t) AS DOUBLE), 6) AS recall FROM r" for k in (1, 2, 3, 5, 8, 12)))
def recall_curve(spark, d):
    """Recall by rank, where the pairs of probability 0.8 or more stand for the truth."""
    df = pairs.competition(entities.scored_pairs(spark, d))
    cand = F.concat_ws("-", "src", "q_id").alias("cand_id")
    return evaluation.recall_curve(df.select("s1_id", cand, "rank"), df.where("p >= 0.8").select("s1_id", cand))


# Samples and folds.


@query("SELECT o_orderkey AS id, CAST(((o_orderkey * 2654435761) % 4294967296) % 10 AS BIGINT) AS fold, o_orderkey % 10 = 0 AS held_out FROM orders")
def folds(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), sampling.fold(F.col("o_orderkey")).alias("fold"), sampling.nth_split(F.col("o_orderkey")).alias("held_out"))


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) ORDER BY md5(concat_ws('-', 42, c_custkey)), c_custkey LIMIT 100)")
def uniform_sample(spark, d):
    customers = table(spark, d, "customer").select("c_custkey")
    return sampling.uniform_sample(customers, 100, ["c_custkey"], exclude=table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")))


@query(f"""WITH {SCORED_SQL}, x AS (SELECT concat('S1-', s1_id) AS s1_id, concat_ws('-', src, q_id) AS cand_id, CAST(p >= 0.8 AS INTEGER) AS label FROM scored),
r AS (SELECT *, sum(label) OVER (PARTITION BY s1_id) AS pos, row_number() OVER (PARTITION BY s1_id, label ORDER BY md5(concat_ws('-', 42, s1_id, cand_id)), cand_id) AS n FROM x) SELECT s1_id, cand_id, label FROM r WHERE label = 1 OR n <= greatest(2, 3 * pos)""")
def negative_sample(spark, d):
    df = entities.scored_pairs(spark, d).select(F.concat(F.lit("S1-"), "s1_id").alias("s1_id"), F.concat_ws("-", "src", "q_id").alias("cand_id"), (F.col("p") >= 0.8).cast("int").alias("label"))
    return sampling.negative_sample(df)


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def skipping_sample(spark, d):
    return sampling.skipping_sample(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 1000, 500, ["id"])
