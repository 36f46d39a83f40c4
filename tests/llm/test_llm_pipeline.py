"""The pipeline's stages on a small fixture with planted cases."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from linkloom.llm import langid, mixing, pii
from linkloom.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def test_all_thirteen_operators_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.collect()
    doc = next(r for r in rows if r["lang"] == "en" and r["n_chars"] > 1500)
    lang, source = doc["lang"], doc["source"]
    extra = [
        (900001, doc["text"], lang, source, 1), (900002, "漢字仮名交じり文の例です。" * 20, lang, source, 1), (900003, None, lang, source, 1), (None, "the of and to in is " * 8, lang, source, 1),
        (900004, doc["text"][:900] + " mail ann.bee@corp.example.com now", None, None, None), (900005, "12345 !!!", lang, source, 1),
    ]
    planted = docs.select(corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(extra, docs.select(corpus_pipeline.COLUMNS).schema))
    held, first = {}, planted
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, planted, DIR)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        planted = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = planted.collect()
    ids = lambda name: {r["doc_id"] for r in held[name]}
    assert {900002, 900003, 900005} & ids("language") == set() and {900001, 900004, None, doc["doc_id"]} <= ids("language")
    # Each stage once more, by plain Python over what it got.
    models = langid.train(first)
    judged = langid.judge(langid.Scorer(models), [r["text"] or "" for r in first.collect()], 8.0)
    expected = sorted(((r["doc_id"], r["text"], lang) for r, (lang, _, rejected, _) in zip(first.collect(), judged, strict=True) if not rejected), key=str)
    assert sorted(((r["doc_id"], r["text"], r["lang"]) for r in held["language"]), key=str) == expected
    check_near_duplicates(held["language"], held["near_duplicates"])
    assert 900001 not in ids("near_duplicates") and {None, 900004} <= ids("near_duplicates")
    check_personal_data(held["near_duplicates"], held["personal_data"])
    check_mixture(held["personal_data"], held["mixture"])
    check_packing(held["mixture"], held["packing"])


def word_sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def check_near_duplicates(before, after):
    """All pairs of sets of five-word shingles, components by spreading labels."""
    sets = {(r["doc_id"], r["text"]): word_sets(r["text"]) for r in before}
    keys = sorted(sets, key=lambda k: (k[0] is None, k[0] or 0, k[1] or ""))
    label = {k: i for i, k in enumerate(keys)}
    links = [(a, b) for a, b in combinations(keys, 2) if (len(sets[a] & sets[b]) / u if (u := len(sets[a] | sets[b])) else 1.0) >= 0.8]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    groups = {}
    for k in keys:
        groups.setdefault(label[k], []).append(k)
    assert len(groups) < len(keys)
    kept = {(r["doc_id"], r["text"]) for r in after}
    assert len(after) == len(kept) == len(groups)
    for own in groups.values():
        assert len(kept & set(own)) == 1 and next(iter(kept & set(own)))[0] == own[0][0]


def check_personal_data(before, after):
    assert len(before) == len(after) and all(r["n_chars"] == len(r["text"]) for r in after)
    now = {r["doc_id"]: r["text"] for r in after}
    surrogates = {}
    for r in before:
        spans, at, end = pii.find(r["text"]), 0, 0
        new = now[r["doc_id"]]
        assert bool(spans) == (new != r["text"])
        for s, following in zip(spans, [*spans, None][1:], strict=True):  # what is between entities stays
            plain = r["text"][end : s.start]
            assert new.startswith(plain, at)
            at, end = at + len(plain), s.end
            tail = r["text"][s.end : following.start] if following else r["text"][s.end :]
            stop = (new.index(tail, at) if following else len(new) - len(tail)) if tail else at + len(s.text)
            surrogates.setdefault((s.kind, s.form), set()).add(new[at:stop].lower())
            at = stop
    private = {s.text for r in before for s in pii.find(r["text"])}
    assert "ann.bee@corp.example.com" in private
    assert not any(p in t for t in now.values() for p in private if len(p) > 8)
    emails = [next(iter(v)) for (kind, _), v in surrogates.items() if kind == "email" and len(v) == 1]
    assert len(emails) == len(set(emails)) and len(emails) == sum(kind == "email" for kind, _ in surrogates)


def check_mixture(before, after):
    """Every leaf delivers its budget: whole epochs, then a prefix in the seeded order; budgets by repeated filling."""
    targets = mixing.Targets()
    leaves = {}
    for r in before:
        number = re.search(r"(\d{1,9})$", r["source"] or "")
        domain = ("web", "books", "dialogue")[int(number[1]) % 3] if number else "other"
        leaves.setdefault((domain, r["lang"] or "null", r["source"] or "null"), []).append(r)
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    supply = {leaf: sum(map(words, own)) for leaf, own in leaves.items()}

    def fill(budget, children):  # name -> (weight, limit)
        given, open_ = {}, dict(children)
        while open_:
            total = sum(w for w, _ in open_.values())
            full = [n for n, (w, c) in open_.items() if c <= budget * w / total + 1e-9]
            if not full:
                return given | {n: budget * w / total for n, (w, _) in open_.items()}
            for n in full:
                given[n] = open_.pop(n)[1]
                budget -= given[n]
        return given

    limit = lambda n, *head: sum(v for leaf, v in supply.items() if leaf[:n] == head) * targets.max_epochs
    domains = fill(sum(supply.values()), {d: (targets.domains.get(d, 1.0), limit(1, d)) for d in {leaf[0] for leaf in leaves}})
    budgets = {}
    for d, budget in domains.items():
        langs = fill(budget, {x: (targets.languages.get(x, 1.0), limit(2, d, x)) for x in {leaf[1] for leaf in leaves if leaf[0] == d}})
        for x, share in langs.items():
            budgets |= {(d, x, s): v for s, v in fill(share, {leaf[2]: (1.0, limit(3, *leaf)) for leaf in leaves if leaf[:2] == (d, x)}).items()}
    expected = Counter()
    for leaf, own in leaves.items():
        budget = math.floor(round(budgets[leaf], 3))
        epochs, rest = divmod(budget, supply[leaf])
        for r in sorted(own, key=lambda r: (hashlib.md5("-".join(str(x) for x in (17, epochs, r["doc_id"]) if x is not None).encode()).hexdigest(), r["doc_id"] or 0)):
            n = words(r)
            expected[r["doc_id"], n] += epochs + (n <= rest)
            if 0 < rest < n:
                expected[r["doc_id"], rest] += 1
            rest = max(0, rest - n)
    assert Counter((r["doc_id"], words(r)) for r in after) == +expected
    text_of = {r["doc_id"]: r["text"] for r in before}
    assert all(text_of[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in after)


def check_packing(before, after):
    """Every piece of every row once, in sequences without gaps, by the tokenizers library."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for r in before:
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : first if not k else start + 1024]
            wanted[r["doc_id"], k, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == wanted
    sequences = {}
    for r in after:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 1024
    assert len(sequences) <= 1.02 * sum(n * k[3] for k, n in wanted.items()) / 1024 + 2


def test_one_id_on_two_texts(spark):
    """A keeper is a row, not an id."""
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (2, "one two three four five six"), (3, "alpha beta gamma delta epsilon zeta"), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and "sequence_id" in out.columns
