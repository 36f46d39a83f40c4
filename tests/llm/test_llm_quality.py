"""op3 against a plain reading of its definition."""

import os
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def counts(text):
    words = quality.WORD.findall(text)
    return len(words), sum(map(len, words)), len(quality.SYMBOL.findall(text)), quality.duplicate_lines(text), quality.repeated_words(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#", "\n", "\t", " ", "\x1c", "ab*", "\x85"]), max_size=80))
def test_counts(parts):
    text = " ".join(parts)
    assert counts(text) == brute(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60))
def test_repeats(words):
    assert quality.repeated_words(words) == brute(" ".join(words))[4]


def test_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1")
    prose = docs.where("n_chars BETWEEN 1500 AND 4000").join(good, "doc_id").orderBy("doc_id").first()["text"]
    rows = [
        (1, prose), (2, "spam ham " * 500), (3, os.urandom(1500).hex() * 1 + " " + " ".join(str(i) for i in range(40))), (4, None), (5, ""), (6, "few words"), (None, prose), (1, prose),
        (7, " ".join("".join(chr(c % 90 + 35) for c in os.urandom(60)) for _ in range(60))), (8, prose + ("\n" + "x" * 40) * 2000),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in quality.assess(df).collect()}
    assert got[1]["kept"] and got[None]["kept"] and not got[1]["base_failed"]
    assert got[2]["base_failed"] and not got[2]["kept"]
    assert not got[4]["kept"] and got[4]["n_words"] == 0 and got[5]["base_failed"] and got[6]["base_failed"]
    assert not got[7]["base_failed"] and not got[7]["kept"]  # near to random
    assert not got[8]["kept"]
    for i, text in rows:
        if i and text is not None:
            assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(text)[:5] or i == 8
    assert quality.assess(df.limit(0)).count() == 0


def test_chunks_reject_a_repetitive_half():
    judge = quality.Compressor(quality.Bands()).judge
    prose = " ".join(f"{w}{i}" for i in range(1200) for w in ("alpha", "of", "beta"))
    assert judge(b"")[0] == 1.0
    assert not judge((prose[:6000] + "na " * 4000).encode())[2]


def test_no_byte_escapes_the_chunks():
    """The tail counts like any chunk, and short texts have chunks too."""
    bands = quality.Bands()
    judge = quality.Compressor(bands).judge
    noise = os.urandom(40_000).hex().encode()
    prose = open(__file__, "rb").read()
    for good, bad in ((2048, 1500), (1000, 1900), (2048 * 3, 2000)):
        whole, share, _ = judge(prose[:good] + noise[:bad])
        want = plain(prose[:good] + noise[:bad], bands)
        assert (whole, share) == (want[0], want[1])
    assert judge(prose[:2048] + b"na " * 500)[1] > 0.4 and not judge(prose[:2048] + b"na " * 500)[2]


def plain(data, bands):
    import zstandard

    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(b))
    row = lambda n: [(lo, hi) for below, lo, hi in bands.whole if n < below][0]
    if not data:
        return 1.0, 0.0, True
    parts = [data[i : i + 2048] for i in range(0, len(data), 2048)]
    limits = [bands.chunk if len(p) == 2048 else row(len(p)) for p in parts]
    bad = sum(len(p) for p, (lo, hi) in zip(parts, limits, strict=True) if not lo <= ratio(p) <= hi)
    lo, hi = row(len(data))
    return ratio(data), bad / len(data), lo <= ratio(data) <= hi and bad / len(data) <= 0.3


def test_verdicts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    kept = 0
    for r in quality.assess(docs).collect():
        text = texts[r["doc_id"]]
        n, *_, repeated = brute(text) if len(text) < 4000 else counts(text)
        failed = n < 20 or 100 * repeated > 30 * n
        whole, share, good = plain(text.encode(), quality.Bands())
        assert (r["base_failed"], r["kept"], r["ratio"], r["bad_chunks"]) == (failed, good and not failed, whole, share)
        kept += r["kept"]
    assert kept > 0.6 * len(texts)
