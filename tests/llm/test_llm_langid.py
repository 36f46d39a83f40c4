"""op10: probabilities that add up, accuracy on what wasn't learned, rejection, awkward rows."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from linkloom.llm import langid

DIR = "/root/testdata/sf0.01"


def test_probabilities_add_up():
    model = langid.fit("x", ["abab ba cab", "abc cab bab"] * 6, 10**6)
    scorer = langid.Scorer([model])
    for context in ("    ", "abab", "zzzz", " cab"):
        windows = np.array([[ord(c) for c in context] + [x] for x in {ord(c) for c in "abc z"}], dtype=np.uint32)
        assert np.exp2(scorer._look_up(windows)[:, 0].astype(float)).sum() < 1.0 + 1e-5
    seen = [ord(c) for c in "abc "]
    windows = np.array([[ord(c) for c in "    "] + [x] for x in seen], dtype=np.uint32)
    mass = np.exp2(scorer._look_up(windows)[:, 0].astype(float)).sum()
    unseen = 2.0 ** float(scorer._look_up(np.array([[32, 32, 32, 32, 0x1234]], dtype=np.uint32))[0, 0]) * (langid.ALPHABET - len(seen))
    assert mass + unseen == pytest.approx(1.0, abs=1e-3)


def plain_kneser_ney(texts):
    """P(character | the four before it) by the textbook, in dictionaries."""
    padded = ["    " + t for t in texts]
    counts = {5: Counter(t[i - 4 : i + 1] for t in padded for i in range(4, len(t)))}
    for n in range(4, 0, -1):
        counts[n] = Counter(gram[1:] for gram in counts[n + 1])  # one for each different character on the left
    discounts = {}
    for n, own in counts.items():
        once, twice = (sum(c == k for c in own.values()) for k in (1, 2))
        discounts[n] = min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5

    def p(gram):
        if not gram:
            return 1 / langid.ALPHABET
        n = len(gram)
        after = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total, d = sum(after.values()), discounts[n]
        return max(0, after.get(gram, 0) - d) / total + d * len(after) / total * p(gram[1:])

    return p


def test_against_a_plain_kneser_ney():
    texts = ["the cat sat on the mat", "a cat and a hat", "that hat sat", "on and on the cat", "hätte", "the"]
    model = langid.estimate("x", texts, 10**6)
    p = plain_kneser_ney(texts)
    for text in ["the hat on the cat", "zebra cat", "ab", "a", "häta the"]:
        padded = "    " + text
        want = [math.log2(p(padded[i - 4 : i + 1])) for i in range(4, len(padded))]
        assert langid.Scorer([model]).per_char([text]) == pytest.approx(want, abs=1e-4)


def test_cut_models_still_add_up():
    """The rarest n-grams of an order give what they had to the back-off."""
    texts = ["abab ba cab cc", "abc cab bab aab", "ccb"]
    for most in (1, 3, 8):
        model = langid.estimate("x", texts, most)
        scorer = langid.Scorer([model])
        assert len(model.gram_keys) <= 5 * most
        for context in ("    ", "abab", " cab", "zzzz"):
            rows = [[ord(c) for c in context] + [ord(x)] for x in "abc "] + [[ord(c) for c in context] + [0x1234]]
            prob = np.exp2(scorer._look_up(np.array(rows, dtype=np.uint32))[:, 0].astype(float))
            assert prob[:4].sum() + prob[4] * (langid.ALPHABET - 4) == pytest.approx(1.0, abs=1e-3)


def test_texts_are_counted_in_runs(monkeypatch):
    texts = ["the cat sat on the mat", "a cat", "", "on the mat a cat sat"] * 3
    whole = langid.estimate("x", texts, 10**6)
    monkeypatch.setattr(langid, "FIT_CHARS", 7)
    parts = langid.estimate("x", texts, 10**6)
    assert (whole.gram_keys == parts.gram_keys).all() and whole.gram_logp == pytest.approx(parts.gram_logp)


def test_no_language_is_lost(spark):
    """Rows without an id, long texts, and copies without number hide no language; so many labels are all learned."""
    schema = "doc_id long, text string, lang string"
    rows = [(None, f"the cat {i}", "en") for i in range(500)] + [(i, f"le chat {'abcdefgh'[i % 8]}", "fr") for i in range(300)]
    assert [m.lang for m in langid.train(spark.createDataFrame(rows, schema))] == ["en", "fr"]
    rows = [(i, "xyz zyx " * 4000, "xx") for i in range(20)] + [(i, f"le chat {'abcdefgh'[i % 8]}", "fr") for i in range(300)]
    assert [m.lang for m in langid.train(spark.createDataFrame(rows, schema))] == ["fr", "xx"]
    bounds = langid.TrainingBounds(docs_per_lang=2)
    rows = [(1, "der hund", "de")] * 5000 + [(i, f"der hund {'abc'[i % 3]}", "de") for i in range(2, 5)] + [(i, "ab", f"l{i % 9}") for i in range(40)]
    learned = Counter(lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    assert [m.lang for m in langid.train(spark.createDataFrame(rows, schema), bounds)] == sorted(learned)


def test_any_number_of_labels_can_be_predicted(spark):
    """450 labels, each with words of its own: every one is learned whole, in one group of models or in many."""
    word = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(3)) + "qxz"[n % 3]
    rows = [(40 * n + i, f"{word(n)} {word(n)}{word(n)} {word(n)}", f"l{n:03d}") for n in range(450) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(learned) > 440
    alone = langid.fit("l007", [rows[21][1]], 10**6)
    found = {}
    for name, size in (("one", 10**9), ("many", 40_000)):
        models = langid.train(docs, langid.TrainingBounds(group_bytes=size))
        assert (len(models.groups) > 5) == (name == "many")
        own = list(models)
        assert {m.lang for m in own} == learned and len(next(m for m in own if m.lang == "l007").gram_keys) == len(alone.gram_keys)
        found[name] = {r["doc_id"]: r for r in langid.identify(docs, models, ["doc_id"]).collect()}
    for i, _, lang in rows:
        one, many = found["one"][i], found["many"][i]
        assert one["lang_pred"] == many["lang_pred"] and (lang not in learned or one["lang_pred"] == lang)
        assert one["score"] == pytest.approx(many["score"], rel=1e-5) and one["rejected"] == many["rejected"] and one["cross_entropy"] == pytest.approx(many["cross_entropy"], abs=1e-5)


def test_many_letters_add_up_to_one():
    """6,000 letters: more than the alphabet that is taken for granted."""
    rng = np.random.default_rng(3)
    letters = [chr(0x4E00 + i) for i in range(6000)]
    model = langid.estimate("zh", ["".join(rng.choice(letters, 400)) for _ in range(60)] + ["".join(letters)], 10**6)
    windows = np.array([[32, 32, 32, 32, ord(c)] for c in [*letters, " "]], dtype=np.uint32)
    scorer = langid.Scorer([model])
    unseen = 2.0 ** float(scorer._look_up(np.array([[32, 32, 32, 32, 0x1234]], dtype=np.uint32))[0, 0])
    assert np.exp2(scorer._look_up(windows)[:, 0].astype(float)).sum() + unseen * (model.alphabet - 6001) == pytest.approx(1.0, abs=1e-3)


def test_one_text_calibrates_no_rejection():
    alone, two = langid.fit("x", ["abc abc"], 100), langid.fit("y", ["abc abc", "abd abd"], 100)
    assert alone.mean == float("inf") and 0 < two.mean < 20
    assert not langid.judge(langid.Scorer([alone]), ["qqq"], 8.0)[0][2]


def test_totals_do_not_depend_on_the_batch():
    model = langid.fit("x", ["the cat sat on the mat", "a dog and the cat"] * 8, 10**6)
    texts = ["The cat!", "", "123", "zebra the", "the  cat\nsat"]
    together, sizes = langid.Scorer([model]).totals(texts)
    alone = [langid.Scorer([model]).totals([t])[0][0, 0] for t in texts]
    assert together[:, 0] == pytest.approx(alone, abs=1e-4) and sizes[1] == sizes[2] == 0


def test_held_out_accuracy_and_no_rejection_of_learned_languages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    models = langid.train(docs)
    assert [m.lang for m in models] == ["de", "en", "es", "fr"]
    got = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text"), models, ["doc_id"]).collect()}
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{DIR}/documents.parquet'").fetchall()
    held = [(d, lang) for d, lang in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    right = sum(got[d]["lang_pred"] == lang for d, lang in held)
    assert right / len(held) > 0.97
    assert sum(got[d]["rejected"] for d, _ in held) <= 0.01 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    strange = ["Ωmega κόσμος ἀλήθεια φιλοσοφία λόγος ψυχή", "漢字仮名交じり文の例です", "qzxv jkqx vvzq xqjz kzqv wqxz jvqk zxwq"]
    out = langid.identify(spark.createDataFrame([(s,) for s in strange], "text string"), models, ["text"]).collect()
    assert all(r["rejected"] and r["lang_pred"] != langid.UNDETERMINED for r in out)


def test_held_out_documents_are_not_learned(spark):
    rows = [(i, f"{'aaa bbb ' * 9}{i}" if zlib.crc32(str(i).encode()) % 4 != 2 else "zzz yyy " * 9, "x") for i in range(60)] + [(None, "ccc", "x"), (77, "ddd eee", None), (78, None, "x"), (79, "", "y")]
    models = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    (model,) = models
    assert model.lang == "x"
    known = set(model.gram_keys.tolist())
    assert int(langid.gram_hashes(np.array([ord("a")], np.uint32), 1)[0]) in known
    assert int(langid.gram_hashes(np.array([ord("z")], np.uint32), 1)[0]) not in known


def test_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    docs = spark.createDataFrame([(1, "abc abc", "x", "s"), (2, None, "x", "s"), (3, "", None, "s"), (4, "123 !", "x", "s"), (None, "abc", "y", "s"), (1, "abc abc", "x", "s"), (5, "abc " * 400_000, "x", "s")], schema)
    models = langid.train(docs)
    got = sorted((r["doc_id"] or 0, r["lang_pred"], r["rejected"]) for r in langid.identify(docs, models, ["doc_id"]).collect())
    assert [g[1] for g in got if g[0] in (2, 3, 4)] == ["und"] * 3 and all(g[1] in ("x", "y") for g in got if g[0] in (1, 5))
    assert langid.identify(docs.limit(0), models, ["doc_id"]).count() == 0
    assert list(langid.train(docs.limit(0))) == [] and {r['lang_pred'] for r in langid.identify(docs, langid.train(docs.limit(0)), ['doc_id']).collect()} == {'und'}
    assert {r["lang_pred"] for r in langid.identify(docs, [], ["doc_id"]).collect()} == {"und"}
