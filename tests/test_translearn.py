"""Spellings of native words, learned from records whose parents spell them in Latin letters."""

from linkloom.operators import translearn

SCHEMA = "entity_id string, business_name string, business_address string, country string"
WORDS = {"टाटा": "tata", "मोटर्स": "motors", "स्टील": "steel", "बैंक": "bank", "होटल": "hotel"}


def test_words_are_learned(spark):
    native, latin, truth = [], [], []
    words = list(WORDS)
    for i in range(60):
        own = [words[i % 5], words[(i * 3 + 1) % 5]]
        native.append((f"S2-{i}", " ".join(own), "12 Park Lane", "IN"))
        latin.append((f"S1-{i}", " ".join(WORDS[w] for w in own), f"{i} Park Lane", "IN"))
        truth.append((f"S1-{i}", f"S2-{i}"))
    native += [("S2-x", "plain words", "", "IN")]
    got = translearn.learn(spark.createDataFrame(native, SCHEMA), spark.createDataFrame(latin, SCHEMA), spark.createDataFrame(truth, "s1_id string, cand_id string"), keep=1.0)
    assert {r["token"]: r["spelling"] for r in got.collect()} == WORDS
    none = translearn.learn(spark.createDataFrame(native[-1:], SCHEMA), spark.createDataFrame(latin, SCHEMA), spark.createDataFrame(truth, "s1_id string, cand_id string"), keep=1.0)
    assert none.count() == 0


def test_learned_spellings_are_used(spark):
    from linkloom.functions import translit

    df = spark.createDataFrame([("S2-1", "टाटा मोटर्स", "", "IN")], SCHEMA)
    assert translit.name_forms(df, learned=WORDS).first()["n_norm"] == "tata motors"
