"""Normalisation on literal cases and against Python's own Unicode."""

import unicodedata
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import folding, text, translit


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (text.normalize_text, "Café René & Co.", "cafe rene co"), (text.normalize_name, "Apex Logistics Private Limited", "apex logistics pvt ltd"), (text.normalize_name, "The Royal Hotel & Suites, LLC", "royal hotel suites llc"),
        (lambda c: text.normalize_name(c, True), "Acme Corporation Ltd", "acme"), (lambda c: text.normalize_name(c, True), "Pvt Ltd", "pvt"), (text.normalize_address, "123 Main Street, Suite 100", "123 main st ste 100"),
        (lambda c: text.compact(text.normalize_address(c)), "123 Main St. Ste #100", "123mainstste100"), (text.normalize_country, "U.S.A.", "US"), (text.normalize_country, "Bharat", "INDIA"), (text.normalize_country, "", "UNKNOWN"),
        (text.normalize_country, "España", "ESPANA"), (text.normalize_name, None, ""), (text.fast_text, "a_b-c", "a b c"), (text.fast_text, "É_b-c", "e_b c"), (text.fast_country, "U.S.A.", "US"),
    ],
)
def test_normalisation(spark, f, value, expected):
    assert col(spark, value, f) == expected


def test_folding_is_that_of_unicode(spark):
    """Every assigned character between two letters: Greek, Cyrillic, Hangul, full width, ligatures and all."""
    texts = [f"a{chr(c)}z" for c in (*range(0x20, 0xD800), *range(0xE000, 0x30000)) if unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(texts[i : i + 50]) for i in range(0, len(texts), 50)] + ["Ά έ Й ё 한국 ＡＢＣ ﬁn ½ Ǆ Æ ß नमस्ते", "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", text.fold_accents(F.col("x")).alias("a"))
    assert [r for r in df.collect() if r["a"] != folding.fold_text(r["x"])] == []
    assert spark.range(1).select(text.fold_accents(F.lit(None).cast("string"))).first()[0] is None
    got = spark.createDataFrame([("Ｃａｆé ﬁne Ёлка ΆΛΦΑ",)], "x string").select(text.normalize_text(F.col("x"))).first()[0]
    assert got == "cafe fine елка αλφα"


def test_ngrams_crc_and_bits(spark):
    row = spark.createDataFrame([("abcd", "ab", "", "é")], "a string, b string, c string, d string")
    got = row.select(*(text.char_ngrams(F.col(c), 3) for c in "abc"), text.crc32_of(F.col("d"))).first()
    assert list(got)[:3] == [["abc", "bcd"], ["ab"], []] and got[3] == zlib.crc32("é".encode())
    words = [f"w{i}" for i in range(70)]
    lanes = spark.createDataFrame([(words,)], "w array<string>").select(*text.bitset_256(F.col("w"))).first()
    bits = {(lane, b) for lane in range(4) for b in range(64) if lanes[lane] >> b & 1}
    assert bits == {(h >> 6, h & 63) for h in (zlib.crc32(w.encode()) & 255 for w in words)}


@pytest.mark.parametrize(("word", "expected"), [("phone", "fn"), ("bhaskar", "bskr"), ("123", "123"), ("a", "a"), ("wizard", "vjrd"), ("school", "scl"), ("yoyo", "y"), ("xerox", "ksrks")])
def test_skeleton(spark, word, expected):
    assert col(spark, word, translit.skeleton) == expected


def test_forms(spark):
    rows = [("Dr. A.B.C. Traders (P) Ltd. dba Blue-Star", "12B, Main Street 3rd Floor, Mumbai, Maharashtra, 400001"), ("www.zander-blue.com", "na, NY"), ("Société Générale SA", "21 rue de l'Église, Île de France"), (None, None)]
    got = translit.prepared(spark.createDataFrame(rows, "business_name string, business_address string")).collect()
    assert got[0]["n_core"] == "abc traders blue star"[:11] + got[0]["n_core"][11:] and got[0]["n_alt"] == "blue star" and "abc" in got[0]["n_core"]
    assert got[0]["a_norm"] == "12 b main st 3 fl mumbai 400001" and got[0]["a_state"] == "mh" and got[0]["a_postal"] == "400001" and got[0]["a_first_num"] == "12"
    assert got[1]["n_domain"] == "zanderblue" and got[1]["a_state"] == "ny" and got[1]["a_empty"] == 1
    assert got[2]["n_norm"] == "ste generale sa" and got[2]["a_norm"] == "21 rue leglise" and got[2]["a_state"] == "fr_idf"
    assert got[3]["n_norm"] == "" and got[3]["a_empty"] == 1


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=12))
def test_ascii_fold_is_ascii(value):
    assert folding.ascii_fold_text(value).isascii()
    assert folding.ascii_fold_text("Straße Øl Привет नमन").isascii()
