"""Pieces of DuckDB's SQL that the oracles share."""

from __future__ import annotations

from linkloom.functions import text, url
from linkloom.operators import blocking, pairs


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def case(expr: str, mapping: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {expr} END"


def norm_text(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def canonical(x: str, mapping: dict[str, str]) -> str:
    return f"list_transform(list_filter(string_split({x}, ' '), lambda w: w <> '' AND w NOT IN ({quoted(text.STOPWORDS)})), lambda w: {case('w', mapping)})"


NAME_MAP = text.BUSINESS_WORDS | text.LEGAL_SUFFIXES
SUFFIX = rf"(?: (?:{'|'.join(text.SUFFIX_WORDS)}))+$"
COUNTRY = rf"(CASE WHEN trim(coalesce(country, '')) = '' THEN 'UNKNOWN' ELSE {case("trim(regexp_replace(upper(trim(country)), '[^\\w\\s]', '', 'g'))", text.COUNTRIES)} END)"


def normalized(source: str, name: str = "norm") -> str:
    """Normalised records of a table, as a common table expression."""
    return f"""
{name}_a AS (SELECT *, array_to_string({canonical(norm_text('business_name'), NAME_MAP)}, ' ') AS name_norm, array_to_string({canonical(norm_text('business_address'), text.ADDRESS_WORDS)}, ' ') AS addr_norm, {COUNTRY} AS country_norm FROM {source}),
{name} AS (SELECT *, regexp_replace(name_norm, '{SUFFIX}', '') AS name_stripped, replace(name_norm, ' ', '') AS name_compact, list_filter({words('name_norm')}, lambda w: length(w) >= 2) AS name_tokens,
  replace(addr_norm, ' ', '') AS addr_compact, {words('addr_norm')} AS addr_tokens FROM {name}_a)"""


def ngrams(x: str, n: int) -> str:
    return f"CASE WHEN {x} = '' THEN [] WHEN length({x}) < {n} THEN [{x}] ELSE list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n})) END"


DIGITS = "regexp_full_match({0}, '[0-9]+')"


def keys(source: str, name: str = "keys") -> str:
    """Blocking keys (entity_id, blocker, key) of normalised records."""
    digit = "regexp_full_match(w, '[0-9]+')"
    nums = r"regexp_extract_all(addr_norm, '\b[0-9]+\b')"
    first, second = f"({words('name_norm')})[1]", f"({words('name_norm')})[2]"
    street = f"(list_filter(regexp_extract_all(addr_norm, '[a-z]+'), lambda w: length(w) >= 4 AND w NOT IN ({quoted(blocking.COMMON_STREET)})))[1]"
    parts = [
        ("name_exact", "['exact_name#' || name_norm]", "name_norm <> ''"),
        ("name_compact", "['compact_name#' || name_compact]", "length(name_compact) >= 3"),
        ("name_token", "list_transform(list_filter(name_tokens, lambda w: length(w) >= 3), lambda w: 'token#' || w)", "true"),
        ("name_ngram", f"list_transform(list_filter({ngrams('name_compact', 3)}, lambda w: length(w) = 3), lambda w: 'ngram3#' || w)", "true"),
        ("address_anchor", f"list_transform(list_filter(addr_tokens, lambda w: {digit} AND length(w) >= 2)[1:3], lambda w: 'addr_num#' || w)", "true"),
        ("address_anchor", f"list_transform(list_filter(addr_tokens, lambda w: NOT {digit} AND length(w) >= 4 AND w NOT IN ({quoted(blocking.ANCHOR_STOP)})), lambda w: 'addr_token#' || w)", "true"),
        ("country_assisted", "['country_token#' || country_norm || '#' || name_tokens[1]]", "country_norm <> 'UNKNOWN' AND length(name_tokens[1]) >= 3"),
        ("composite_key", f"[country_norm || '#name_first#' || {first}]", f"length({first}) >= 3"),
        ("composite_key", "[country_norm || '#name_prefix#' || name_norm[1:4]]", "length(name_norm) >= 4"),
        ("composite_key", f"[country_norm || '#name_sec#' || {second}]", f"length({second}) >= 3"),
        ("composite_key", f"[country_norm || '#num_name#' || {nums}[1] || '#' || name_norm[1:3]]", f"name_norm <> '' AND len({nums}) > 0"),
        ("composite_key", f"[country_norm || '#zip_name#' || list_filter({nums}, lambda w: length(w) IN (5, 6))[1] || '#' || {first}[1:3]]", f"name_norm <> '' AND len(list_filter({nums}, lambda w: length(w) IN (5, 6))) > 0"),
        ("composite_key", f"[country_norm || '#addr_nums#' || {nums}[1] || '#' || {nums}[2]]", f"len({nums}) >= 2"),
        ("composite_key", f"[country_norm || '#addr_num_word#' || {nums}[1] || '#' || {street}]", f"len({nums}) = 1 AND length({nums}[1]) >= 3 AND {street} IS NOT NULL"),
    ]
    return f"{name} AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT entity_id, '{b}' AS blocker, unnest({k}) AS key FROM {source} WHERE {w}" for b, k, w in parts) + "))"


def candidates(most: int = 150, postings: int = 500) -> str:
    """From records: normalised forms, keys of S1 and of the targets, pruned pairs ``cands`` and capped pairs ``capped``."""
    return f"""{normalized('records')},
{keys("norm")},
tkeys AS (SELECT * FROM keys WHERE entity_id NOT LIKE 'S1-%'),
kept AS (SELECT key FROM tkeys GROUP BY key HAVING count(*) <= {postings}),
cands AS (SELECT s.entity_id AS s1_id, t.entity_id AS cand_id, list_sort(list(DISTINCT t.blocker)) AS reasons FROM (SELECT DISTINCT entity_id, key FROM keys WHERE entity_id LIKE 'S1-%') s JOIN tkeys t USING (key) JOIN kept USING (key) GROUP BY ALL),
capped AS (SELECT s1_id, cand_id, reasons FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY len(reasons) DESC, cand_id) AS n FROM cands) WHERE n <= {most})"""


def jaccard(a: str, b: str, empty: str = "1.0") -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END)"


def containment(a: str, b: str) -> str:
    least = f"least(len(list_distinct({a})), len(list_distinct({b})))"
    return f"(CASE WHEN {least} = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / CAST({least} AS DOUBLE) END)"


def over(part: str, whole: str, empty: str) -> str:
    return f"(CASE WHEN {whole} = 0 THEN {empty} ELSE {part} / CAST({whole} AS DOUBLE) END)"


def lengths(a: str, b: str, empty: str = "1.0") -> str:
    return over(f"least(length({a}), length({b}))", f"greatest(length({a}), length({b}))", empty)


def levenshtein(a: str, b: str) -> str:
    return f"(1 - {over(f'levenshtein({a}, {b})', f'greatest(length({a}), length({b}))', '0.0')})"


def gram_jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) < 3 OR length({b}) < 3 THEN CAST({a} = {b} AS DOUBLE) ELSE {jaccard(ngrams(a, 3), ngrams(b, 3))} END)"


def flag(x: str) -> str:
    return f"CAST(coalesce({x}, false) AS DOUBLE)"


def native_features() -> str:
    """``pairs`` (s1_id, cand_id, the native features) of capped candidates."""
    ln, rn, la, ra = "l.name_stripped", "r.name_stripped", "l.addr_norm", "r.addr_norm"
    lt, rt, lw, rw = words(ln), words(rn), words(la), words(ra)
    nums = lambda x: rf"list_distinct(regexp_extract_all({x}, '\b[0-9]+\b'))"
    zips = lambda x: rf"regexp_extract_all({x}, '\b[0-9]{{5,6}}\b')"
    columns = {
        "name_raw_exact": flag("l.business_name = r.business_name AND l.business_name <> ''"), "name_norm_exact": flag(f"{ln} = {rn} AND {ln} <> ''"), "name_token_jaccard": jaccard(lt, rt),
        "name_token_containment": containment(lt, rt), "name_levenshtein": levenshtein(ln, rn), "name_char_3gram": gram_jaccard(ln, rn), "name_length_ratio": lengths(ln, rn),
        "name_shared_tokens": f"CAST(len(list_intersect({lt}, {rt})) AS DOUBLE)", "addr_norm_exact": flag(f"{la} = {ra} AND {la} <> ''"), "addr_token_jaccard": jaccard(lw, rw),
        "addr_levenshtein": levenshtein(la, ra), "addr_char_3gram": gram_jaccard(la, ra), "addr_num_overlap": jaccard(nums(la), nums(ra)), "addr_shared_nums": f"CAST(len(list_intersect({nums(la)}, {nums(ra)})) AS DOUBLE)",
        "addr_length_ratio": lengths(la, ra), "country_match": flag("l.country_norm = r.country_norm AND l.country_norm <> 'UNKNOWN'"), "postal_code_match": flag(f"list_has_any({zips(la)}, {zips(ra)})"),
    }
    assert list(columns) == pairs.NATIVE
    own = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"pairs AS (SELECT s1_id, cand_id, {own} FROM capped JOIN norm l ON l.entity_id = s1_id JOIN norm r ON r.entity_id = cand_id)"


RULE_SCORED = """
scored AS (SELECT s1_id, cand_id, CASE WHEN country_match = 0 THEN 0.0 WHEN name_norm_exact = 1 AND addr_norm_exact = 1 THEN 1.0 ELSE least(1.0, greatest(0.0,
  CAST(0.55 AS DOUBLE) * (name_token_jaccard * CAST(0.4 AS DOUBLE) + name_levenshtein * CAST(0.3 AS DOUBLE) + name_char_3gram * CAST(0.3 AS DOUBLE))
  + CAST(0.35 AS DOUBLE) * (addr_token_jaccard * CAST(0.4 AS DOUBLE) + addr_levenshtein * CAST(0.3 AS DOUBLE) + addr_num_overlap * CAST(0.3 AS DOUBLE)))) END AS score FROM pairs),
matches AS (SELECT s1_id, cand_id, score FROM (SELECT *, max(score) OVER (PARTITION BY s1_id) AS top FROM scored WHERE score >= 0.5) WHERE score >= greatest(0.5, top - 0.15))"""


# URLs.


def url_tokens(x: str) -> str:
    delims = r"[\s/\\.,;:\-_?=&%+#@!~*|`^$()]+"
    return rf"list_transform(list_filter(regexp_split_to_array(regexp_replace({x}, '([A-Z])', ' \1', 'g'), '{delims}'), lambda t: length(t) > 1), lambda t: lower(t))"


def url_entropy(x: str) -> str:
    chars = f"list_distinct(string_split({x}, ''))"
    share = f"((length({x}) - length(replace({x}, c, ''))) / CAST(length({x}) AS DOUBLE))"
    return f"(CASE WHEN {x} = '' THEN 0.0 ELSE round(list_sum(list_transform({chars}, lambda c: -{share} * log2({share}))), 4) END)"


def count_of(x: str, char: str) -> str:
    return f"CAST(length({x}) - length(replace({x}, '{char}', '')) AS INTEGER)"


def tokenized() -> str:
    """``tok``: pages with the parts and tokens of their URLs."""
    split = r"^([a-zA-Z][a-zA-Z0-9+\-.]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda i: f"regexp_extract(normalized_url, '{split}', {i}, 's')"
    multi = f"(len(labels) > 2 AND array_to_string(labels[-2:], '.') IN ({quoted(url.MULTI_TLDS)}))"
    return rf"""
u0 AS (SELECT page_id, url, CASE WHEN trim(coalesce(url, '')) = '' THEN '' WHEN regexp_matches(trim(url), '{url.SCHEME}') THEN trim(url) ELSE concat('http://', trim(url)) END AS normalized_url FROM pages),
u1 AS (SELECT *, lower({part(1)}) AS scheme, {part(2)} AS netloc, {part(3)} AS path, {part(4)} AS query, {part(5)} AS fragment FROM u0),
u2 AS (SELECT *, lower(regexp_extract(regexp_replace(netloc, '^.*@', ''), '^([^:]*)', 1)) AS host, TRY_CAST(nullif(regexp_extract(netloc, ':([0-9]+)$', 1), '') AS INTEGER) AS port FROM u1),
u3 AS (SELECT *, string_split(host, '.') AS labels, regexp_matches(host, '{url.IPV4}') AS is_ip FROM u2),
u4 AS (SELECT *, CASE WHEN is_ip OR host = '' OR len(labels) = 1 THEN '' WHEN {multi} THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS tld,
  CASE WHEN is_ip OR host = '' OR len(labels) = 1 THEN host WHEN {multi} THEN labels[-3] ELSE labels[-2] END AS domain,
  CASE WHEN is_ip OR host = '' OR len(labels) = 1 THEN [] WHEN {multi} THEN labels[1:len(labels) - 3] ELSE labels[1:len(labels) - 2] END AS subdomains, {url_tokens('path')} AS path_tokens, {url_tokens('query')} AS query_tokens FROM u3),
tok AS (SELECT *, list_concat(CASE WHEN domain = '' THEN [] ELSE list_concat([domain], subdomains) END, list_concat(path_tokens, query_tokens)) AS all_tokens, CASE WHEN tld = '' THEN domain ELSE concat(domain, '.', tld) END AS full_domain FROM u4)"""


def featured() -> str:
    """``feat``: tok with the features."""
    n = "normalized_url"
    vowel = "CASE WHEN full_domain = '' THEN normalized_url ELSE full_domain END"
    vowels, consonants = f"len(regexp_extract_all(lower({vowel}), '[aeiou]'))", f"len(regexp_extract_all(lower({vowel}), '[b-df-hj-np-tv-z]'))"
    digits, special = rf"len(regexp_extract_all({n}, '\d'))", rf"len(regexp_extract_all({n}, '[^\p{{L}}\p{{N}}]'))"
    counts = ", ".join(f"{count_of(n, c)} AS {k}_count" for k, c in (("dot", "."), ("hyphen", "-"), ("underscore", "_"), ("slash", "/"), ("question", "?"), ("equal", "="), ("at", "@"), ("percent", "%")))
    return rf"""
feat0 AS (SELECT *, CAST(length({n}) AS INTEGER) AS url_length, CAST(length(full_domain) AS INTEGER) AS domain_length, CAST(length(path) AS INTEGER) AS path_length, CAST(length(query) AS INTEGER) AS query_length,
  {url_entropy(n)} AS url_entropy, {url_entropy('full_domain')} AS domain_entropy, CAST(CASE WHEN domain = '' THEN 0 ELSE len(subdomains) + 1 END AS INTEGER) AS domain_depth, CAST(len(subdomains) AS INTEGER) AS subdomain_count,
  lower(regexp_extract(netloc, '^([^:]*)', 1)) IN ({quoted(url.SHORTENERS)}) AS is_shortened, scheme = 'https' AS has_https, port IS NOT NULL AS has_port,
  CASE WHEN {consonants} = 0 THEN CAST({vowels} AS DOUBLE) ELSE round({vowels} / CAST({consonants} AS DOUBLE), 4) END AS vowel_to_consonant_ratio,
  CASE WHEN {n} = '' THEN 0.0 ELSE round({digits} / CAST(length({n}) AS DOUBLE), 4) END AS digit_ratio, CASE WHEN {n} = '' THEN 0.0 ELSE round({special} / CAST(length({n}) AS DOUBLE), 4) END AS special_char_ratio,
  CAST({digits} AS INTEGER) AS digit_count, list_sort(list_distinct(list_filter(all_tokens, lambda t: t IN ({quoted(url.SUSPICIOUS_TOKENS)})))) AS suspicious_tokens, lower(tld) IN ({quoted(url.SUSPICIOUS_TLDS)}) AS has_suspicious_tld, {counts} FROM tok),
feat AS (SELECT *, CAST(len(suspicious_tokens) AS INTEGER) AS suspicious_token_count FROM feat0)"""


def threats() -> str:
    """``threat``: feat with heuristic_score and risk."""
    brand = " OR ".join(f"(contains(lower(url), '{b}') AND NOT contains(lower(url), '.{b}.com') AND NOT contains(lower(url), '//{b}.com'))" for b in url.BRANDS)
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return f"""
threat AS (SELECT *, least(1.0, round(CASE WHEN is_ip THEN {d(0.4)} ELSE 0 END + CASE WHEN is_ip AND suspicious_token_count > 0 THEN {d(0.35)} ELSE 0 END + CASE WHEN at_count > 0 THEN {d(0.5)} ELSE 0 END + CASE WHEN has_suspicious_tld THEN {d(0.3)} ELSE 0 END
  + CASE WHEN subdomain_count >= 3 THEN {d(0.25)} ELSE 0 END + CASE WHEN suspicious_token_count >= 2 THEN least({d(0.35)}, suspicious_token_count * {d(0.15)}) ELSE 0 END + CASE WHEN {brand} THEN {d(0.35)} ELSE 0 END
  + CASE WHEN domain_entropy > 3.6 AND vowel_to_consonant_ratio < 0.2 THEN {d(0.3)} ELSE 0 END, 4)) AS heuristic_score FROM feat),
risk AS (SELECT *, CASE WHEN heuristic_score >= 0.8 THEN 'CRITICAL' WHEN heuristic_score >= 0.6 THEN 'HIGH' WHEN heuristic_score >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM threat)"""


def reputations() -> str:
    """``rep``: tok with reputation and category."""
    score = "CASE full_domain " + " ".join(f"WHEN '{d}' THEN {s}" for d, (_, s) in url.REGISTRY.items()) + " END"
    cat = "CASE full_domain " + " ".join(f"WHEN '{d}' THEN '{c}'" for d, (c, _) in url.REGISTRY.items()) + " END"
    guess = " ".join(f"WHEN regexp_matches(full_domain, '{'|'.join(w)}') OR list_has_any(all_tokens, [{quoted(w)}]) THEN '{c}'" for c, w in url.CATEGORY_KEYWORDS.items())
    gov = r"regexp_matches(full_domain, '\.(gov|edu)$|\.ac\.uk$')"
    hyphens = "(length(full_domain) - length(replace(full_domain, '-', '')))"
    return f"""
rep0 AS (SELECT *, {score} AS known, {cat} AS known_category, 65 - CASE WHEN is_ip THEN 40 ELSE 0 END - CASE WHEN lower(tld) IN ({quoted(url.REPUTATION_TLDS)}) THEN 25 ELSE 0 END - CASE WHEN len(subdomains) > 2 THEN least(20, len(subdomains) * 7) ELSE 0 END
  - CASE WHEN {hyphens} >= 2 THEN least(15, {hyphens} * 5) ELSE 0 END + CASE WHEN scheme = 'https' THEN 5 ELSE 0 END AS base,
  CASE WHEN {gov} THEN 'Government/Education' {guess} ELSE 'Other' END AS guess FROM tok),
rep1 AS (SELECT *, CAST(coalesce(known, greatest(0, least(100, base))) AS INTEGER) AS reputation_score, coalesce(known_category, guess) AS cat0 FROM rep0),
rep AS (SELECT *, CASE WHEN known IS NULL AND reputation_score < 25 AND cat0 = 'Other' THEN 'Malicious/Phishing' ELSE cat0 END AS category,
  CASE WHEN reputation_score >= 80 THEN 'TRUSTED' WHEN reputation_score >= 50 THEN 'NEUTRAL' WHEN reputation_score >= 25 THEN 'SUSPICIOUS' ELSE 'MALICIOUS' END AS reputation_tier FROM rep1)"""
