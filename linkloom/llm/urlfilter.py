"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

In DataFrame functions alone. The filter is a table of blocks of 512 bits; a URL's hash names its
block and one bit in each of the block's eight words, so a probe is one hash join on the
block's number. The number of blocks is a power of two that follows the length of the list. Up to
``MAX_SENT`` blocks (of 72 bytes) go to all tasks, more are joined by shuffle. What passes
goes to a hash join with the exact list, which removes false positives; the rest is done. Rows that
a rule decides ask neither. Rows of one URL are dealt to parts in either join.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and is
never listed; repeated rows are judged alike; empty tables give none; other columns never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import cut, join_split

#: (rule, verdict); longest first.
RULES = (("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block"))
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|msclkid|mc_eid)(=|$)"
MAX_SENT = 1 << 16
URLS_PER_BLOCK = 40  # about 13 bits a URL
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule whose host is the URL's or a parent of it, and whose path begins the URL's."""
    out = None
    for rule, _ in RULES:
        own_host, _, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + rest)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out


def canonical(url: Column) -> Column:
    """Host without www and default port, path without closing slash, parameters sorted and without tracking; null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, "://[^/?#]*[^?#]*\\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(url.contains("://"), F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bit(url: Column, word: int) -> Column:
    """The bit of a word: six bits of a second hash."""
    return F.shiftright(F.xxhash64(F.lit(1), url), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def build_filter(listed: DataFrame) -> tuple[DataFrame, int]:
    """Blocks (block, w0..w7) of the URLs in ``canonical_url``, and the number of blocks."""
    n = listed.count()
    blocks = 1
    while blocks * URLS_PER_BLOCK < n:
        blocks *= 2
    url = F.col("canonical_url")
    one = F.lit(1).cast("long")
    words = [F.bit_or(F.call_function("shiftleft", one, _bit(url, i))).alias(f"w{i}") for i in range(8)]
    return listed.groupBy(_block(url, blocks).alias("block")).agg(*words), blocks


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of op7: distinct canonical URLs of pages that were seen with a campaign's parameters."""
    tagged = pages.where(F.col("url").rlike("[?&]utm_[a-z]+="))
    return tagged.select(canonical(F.col("url")).alias("canonical_url")).where("canonical_url IS NOT NULL").distinct()


def judge(pages: DataFrame, listed: DataFrame, keep: list[str] = ["page_id"]) -> DataFrame:
    """The columns ``keep``, host, path, rule, verdict and listed (false where a rule decides)."""
    listed = cut(listed)
    table, blocks = build_filter(listed)
    url = F.col("url")
    rows = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical_url"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path")))
    open_ = F.col("rule").isNull() & F.col("canonical_url").isNotNull()
    out = [*keep, "host", "path", "rule"]
    decided = rows.where(~open_).select(*out, F.lit(False).alias("listed"))
    asked = rows.where(open_).withColumn("block", _block(F.col("canonical_url"), blocks))
    bits = [F.call_function("getbit", F.col(f"w{i}"), _bit(F.col("canonical_url"), i)) == 1 for i in range(8)]
    passes = bits[0]
    for b in bits[1:]:
        passes = passes & b
    probed = asked.join(F.broadcast(table), "block", "left") if blocks <= MAX_SENT else join_split(asked, table, ["block"], keep)
    probed = probed.select(*out, "canonical_url", F.coalesce(passes, F.lit(False)).alias("passes"))
    exact = join_split(probed.where("passes").drop("passes"), listed.select("canonical_url", F.lit(True).alias("listed")), ["canonical_url"], keep)
    both = exact.select(*out, F.coalesce("listed", F.lit(False)).alias("listed"))
    both = both.unionByName(probed.where("NOT passes").select(*out, F.lit(False).alias("listed"))).unionByName(decided)
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for rule, said in RULES:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return both.select(*out, verdict.alias("verdict"), "listed")


HOST_SQL = f"translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
PATH_SQL = "coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
QUERY_SQL = rf"array_to_string(list_sort(list_filter(string_split(coalesce(regexp_extract(url, '://[^/?#]*[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&')"
#: The canonical form of ``url`` in DuckDB's SQL.
CANONICAL_SQL = rf"""CASE WHEN contains(url, '://') THEN concat(regexp_replace(regexp_replace({HOST_SQL}, '^www\.', ''), ':(80|443)$', ''),
    regexp_replace({PATH_SQL}, '/+$', ''), CASE WHEN {QUERY_SQL} = '' THEN '' ELSE concat('?', {QUERY_SQL}) END) END"""


def oracle() -> str:
    """op7 in DuckDB's SQL, with the exact list alone."""
    rule = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{rest}') THEN '{r}'" for r, _ in RULES for h, _, rest in [r.partition("/")]) + " END"
    said = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)
    return f"""
WITH u AS (SELECT page_id, url, {HOST_SQL} AS host, {PATH_SQL} AS path, {CANONICAL_SQL} AS canon FROM pages),
c AS (SELECT *, {rule} AS rule FROM u),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(url, '[?&]utm_[a-z]+=') AND canon IS NOT NULL),
j AS (SELECT page_id, host, path, rule, rule IS NULL AND canon IS NOT NULL AND canon IN (SELECT canon FROM l) AS listed FROM c)
SELECT page_id, host, path, rule, CASE {said} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM j"""
