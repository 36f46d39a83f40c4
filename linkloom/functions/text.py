"""Normalisation of names, addresses and countries as Column functions: the full set and the fast set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.folding import fold_accents

# Fixed values.
LEGAL_SUFFIXES = {
    "corporation": "corp", "corp": "corp", "incorporated": "inc", "inc": "inc", "limited": "ltd", "ltd": "ltd", "private": "pvt", "pvt": "pvt",
    "company": "co", "co": "co", "llc": "llc", "plc": "plc", "gmbh": "gmbh", "sarl": "sarl", "sa": "sa",
}
BUSINESS_WORDS = {
    "international": "intl", "intl": "intl", "solutions": "sol", "sol": "sol", "technology": "tech", "tech": "tech", "technologies": "tech",
    "services": "svc", "svc": "svc", "center": "ctr", "centre": "ctr", "ctr": "ctr", "management": "mgmt", "mgmt": "mgmt", "development": "dev", "dev": "dev",
}
ADDRESS_WORDS = {
    "street": "st", "st": "st", "road": "rd", "rd": "rd", "avenue": "ave", "ave": "ave", "boulevard": "blvd", "blvd": "blvd", "drive": "dr", "dr": "dr",
    "lane": "ln", "ln": "ln", "court": "ct", "ct": "ct", "apartment": "apt", "apt": "apt", "suite": "ste", "ste": "ste", "building": "bldg", "bldg": "bldg",
    "floor": "fl", "fl": "fl", "highway": "hwy", "hwy": "hwy", "parkway": "pkwy", "pkwy": "pkwy", "square": "sq", "sq": "sq",
    "industrial": "ind", "ind": "ind", "estate": "est", "est": "est",
}
STOPWORDS = ["and", "&", "the", "of", "in", "for", "on", "at", "to", "a", "an"]
COUNTRIES = {
    "UNITED STATES": "US", "UNITED STATES OF AMERICA": "US", "USA": "US", "US": "US", "U S A": "US", "U S": "US", "INDIA": "INDIA", "IND": "INDIA", "BHARAT": "INDIA",
    "UNITED KINGDOM": "UK", "GREAT BRITAIN": "UK", "UK": "UK", "GB": "UK", "FRANCE": "FRANCE", "FR": "FRANCE",
    "GERMANY": "GERMANY", "DE": "GERMANY", "DEUTSCHLAND": "GERMANY", "CANADA": "CANADA", "CA": "CANADA",
}

SUFFIX_WORDS = sorted(set(LEGAL_SUFFIXES) | set(LEGAL_SUFFIXES.values()))


def as_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))


def words_of(text: Column) -> Column:
    """Words between blanks; none for ''."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def mapped(words: Column, *mappings: dict[str, str]) -> Column:
    """Each word's entry in the first mapping that has it, or itself."""
    merged: dict[str, str] = {}
    for mapping in reversed(mappings):
        merged.update(mapping)
    table = as_map(merged)
    return F.transform(words, lambda t: F.coalesce(F.element_at(table, t), t))


def no_stopwords(words: Column) -> Column:
    return F.filter(words, lambda t: ~t.isin(STOPWORDS))


def normalize_text(text: Column) -> Column:
    """Without accents, lower case, punctuation but _ to blanks, single blanks."""
    plain = F.lower(fold_accents(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def strip_suffixes(name: Column) -> Column:
    """Without legal words at its end; the first word stays."""
    return F.regexp_replace(name, rf"(?: (?:{'|'.join(SUFFIX_WORDS)}))+$", "")


def normalize_name(name: Column, strip_legal: bool = False) -> Column:
    own = F.array_join(mapped(no_stopwords(words_of(normalize_text(name))), LEGAL_SUFFIXES, BUSINESS_WORDS), " ")
    return strip_suffixes(own) if strip_legal else own


def normalize_address(address: Column) -> Column:
    return F.array_join(mapped(no_stopwords(words_of(normalize_text(address))), ADDRESS_WORDS), " ")


def compact(normalized: Column) -> Column:
    return F.replace(normalized, F.lit(" "), F.lit(""))


def name_tokens(normalized: Column) -> Column:
    return F.filter(words_of(normalized), lambda t: ~t.isin(STOPWORDS) & (F.length(t) >= 2))


def normalize_country(country: Column) -> Column:
    """Known aliases to one code, others as they are; UNKNOWN for none. Punctuation goes without a blank."""
    clean = F.trim(F.regexp_replace(F.upper(F.trim(fold_accents(F.coalesce(country, F.lit(""))))), r"(?U)[^\w\s]", ""))
    return F.when(clean == "", "UNKNOWN").otherwise(F.coalesce(F.element_at(as_map(COUNTRIES), clean), clean))


def normalized_records(records: DataFrame) -> DataFrame:
    """records (entity_id, business_name, business_address, country) with the normalised forms added."""
    df = records.withColumns({
        "name_norm": normalize_name(F.col("business_name")),
        "addr_norm": normalize_address(F.col("business_address")),
        "country_norm": normalize_country(F.col("country")),
    })
    return df.withColumns({
        "name_stripped": strip_suffixes(F.col("name_norm")), "name_compact": compact(F.col("name_norm")), "name_tokens": name_tokens(F.col("name_norm")),
        "addr_compact": compact(F.col("addr_norm")), "addr_tokens": words_of(F.col("addr_norm")),
    })


# The fast set: exact words instead of hashes, and the hashed payload for those who want it.

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def fast_text(text: Column) -> Column:
    """ASCII: all punctuation to blanks, _ too. Other text: as normalize_text."""
    text = F.coalesce(text, F.lit(""))
    ascii_form = F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION))
    other = F.regexp_replace(F.lower(fold_accents(text)), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(F.when(text.rlike(r"^[\x00-\x7F]*$"), ascii_form).otherwise(other), r"(?U)\s+", " "))


def fast_country(country: Column) -> Column:
    clean = F.upper(fast_text(country))
    return F.when(clean == "", "").otherwise(F.coalesce(F.element_at(as_map(COUNTRIES), clean), clean))


def fast_records(records: DataFrame) -> DataFrame:
    """records with name, name_words, addr, addr_words, addr_nums, postal, country_code, name_grams of the fast set."""
    words = mapped(no_stopwords(words_of(fast_text(F.col("business_name")))), LEGAL_SUFFIXES, BUSINESS_WORDS)
    df = records.withColumns({
        "_words": words,
        "addr_words": mapped(no_stopwords(words_of(fast_text(F.col("business_address")))), ADDRESS_WORDS),
        "country_code": fast_country(F.col("country")),
    })
    df = df.withColumns({
        "fast_name": strip_suffixes(F.array_join("_words", " ")),
        "name_words": F.filter("_words", lambda t: F.length(t) >= 2),
        "fast_addr": F.array_join("addr_words", " "),
        "addr_nums": F.filter("addr_words", lambda t: t.rlike("^[0-9]+$")),
    }).drop("_words")
    postal = F.try_element_at(F.filter("addr_nums", lambda t: F.length(t).isin(5, 6)), F.lit(1))
    return df.withColumns({"postal": F.coalesce(postal.cast("long"), F.lit(0)), "name_grams": F.array_distinct(char_ngrams(compact(F.col("fast_name")), 3))})


def char_ngrams(text: Column, n: int) -> Column:
    """Sliding n-grams; a shorter text is its own, '' has none."""
    slid = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).otherwise(slid)


def crc32_of(text: Column) -> Column:
    return F.crc32(F.encode(text, "utf-8"))


def bitset_256(words: Column) -> list[Column]:
    """Four longs: one bit for each word, by the low eight bits of its CRC."""
    bits = F.transform(F.array_distinct(words), lambda w: F.pmod(crc32_of(w), F.lit(256)).cast("int"))
    one = F.lit(1).cast("long")
    lane = lambda k: F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == k), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, b % 64)))
    return [lane(k) for k in range(4)]


def encoded_records(fast: DataFrame) -> DataFrame:
    """The hashed payload of fast records: scalars and the four bit sets as four longs each."""
    hashed = lambda c: F.when(F.col(c) == "", 0).otherwise(crc32_of(F.col(c)))
    scalars = {
        "name_hash": hashed("fast_name"), "addr_hash": hashed("fast_addr"), "country_hash": hashed("country_code"),
        "name_len": F.length("fast_name"), "addr_len": F.length("fast_addr"),
        "n_name_tok": F.size(F.array_distinct("name_words")), "n_addr_tok": F.size(F.array_distinct("addr_words")), "n_addr_num": F.size(F.array_distinct("addr_nums")),
    }
    lanes = {f"{name}_bits_{k}": c for name, words in (("name_tok", "name_words"), ("name_char", "name_grams"), ("addr_tok", "addr_words"), ("addr_num", "addr_nums")) for k, c in enumerate(bitset_256(F.col(words)))}
    return fast.withColumns(scalars | lanes)
