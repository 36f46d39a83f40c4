"""op13: both tokenizers against their libraries, groups and links against loops over bytes, awkward rows, counts of the corpus."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from linkloom.llm import alignment, queries

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


LETTERS = byte_letters()


def plain_ids(text):
    if not text:
        return [], []
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    parts_a = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    parts_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
        return [], []
    return list(zip(a, map(len, parts_a), strict=True)), list(zip(b, map(len, parts_b), strict=True))


def plain(text):
    """(n_a, n_b, groups, links) by walking over the bytes."""
    a, b = plain_ids(text)
    spans = []
    for side in (a, b):
        at, own = 0, []
        for i, n in side:
            own.append((at, at + n, i))
            at += n
        spans.append(own)
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e] if len(a) < 400 else slow_links(*spans)
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, begin = [], 0
    for end in cuts:
        groups.append("|".join(",".join(str(i) for s, e, i in own if begin <= s and e <= end) for own in spans) if len(a) < 400 else None)
        begin = end
    return len(a), len(b), groups, links


def slow_links(left, right):
    """Each byte's two tokens; a link is a pair of places that some byte has."""
    at = lambda own: [k for k, (s, e, _) in enumerate(own) for _ in range(e - s)]
    return [(left[i][2], right[j][2]) for i, j in sorted(set(zip(at(left), at(right), strict=True)))]


def expected(texts):
    found = [plain(t) for t in texts]
    held = Counter(pair for *_, links in found for pair in set(links))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    rows = []
    for n_a, n_b, groups, links in found:
        digest = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        rows.append((n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return rows


AWKWARD = [
    None, "", " ", "a", "Hello  world\n\n\tx", "naïve café 漢字 𝄞 \x00\x7f", "<|endoftext|> x <s> </s> <unk> <0x41>", "a▁b", "it's we'll 12345 67", "a" * 3000, "= = =   " * 40,
    "trailing   ", "﻿mark", "é é", "🙂👍🏽" * 9, "the the the the", "the the the the", "<|endoftext|>",
]


def compare(spark, texts, partitions=3):
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, groups string, block int").repartition(partitions)
    got = {r["doc_id"]: r for r in alignment.report(frame).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(expected(texts)):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == want[:6], texts[i]
        assert want[6] is None or r["groups_sha256"] == want[6], texts[i]


def test_awkward_texts_against_loops(spark):
    rng = random.Random(8)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 10, 32, 0x2581])) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    compare(spark, AWKWARD + noise)


def test_small_blocks_give_the_same(spark, monkeypatch):
    texts = [("w%d x" % (i % 5)) * (i % 7) for i in range(90)]
    whole = alignment.align(alignment.Tokenizers(alignment.Vocabularies()), texts)
    for n in (0, 1, len(texts)):
        part = alignment.align(alignment.Tokenizers(alignment.Vocabularies()), texts[:n])
        assert part.groups == whole.groups[:n] and part.n_links.tolist() == whole.n_links[:n].tolist()
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 40)
    compare(spark, texts)


def test_query_against_loops_on_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_alignment"](spark, "/root/testdata/sf0.001").collect()}
    for doc, want in zip(docs, expected([d["text"] for d in docs]), strict=True):
        r = got[doc["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == want[:6]
        assert want[6] is None or r["groups_sha256"] == want[6]


def test_null_ids_repeated_rows_and_groups(spark):
    frame = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (None, None)], "doc_id int, text string")
    got = sorted((str(r["doc_id"]), r["n_a"], r["n_best"] == r["n_links"], r["count_sum"], r["groups"]) for r in alignment.report(frame, with_groups=True).collect())
    assert [g[:2] for g in got] == [("5", 2), ("5", 2), ("None", 0), ("None", 2)] and got[0][2] and got[0][3] == 3 * 2
    assert got[0][4] == ";".join(plain("a b")[2]) and got[2][4] == ""
    assert alignment.report(frame.limit(0)).collect() == []


def test_pair_counts(spark):
    frame = spark.createDataFrame([(1, 7, 1, 2), (2, 7, 1, 3), (1, 7, 2, 5), (1, 7, 3, 1), (2, 8, 1, 1)], "block long, a int, b int, held long")
    got = sorted(tuple(r) for r in alignment.pair_counts(frame).select("a", "b", "docs", "blocks", "best").collect())
    assert got == [(7, 1, 5, 2, True), (7, 2, 5, 1, True), (7, 3, 1, 1, False), (8, 1, 1, 1, True)]


def test_a_long_text_is_whole(spark):
    text = "Lorem ipsum dolor, 12345 sit. " * 40_000
    b = alignment.align(alignment.Tokenizers(alignment.Vocabularies()), [text])
    cover = np.zeros(2, int)
    cover[:] = b.n_a[0], b.n_b[0]
    assert b.n_links[0] >= cover.max() and b.times.sum() == b.n_links[0] and b.groups[0].count(";") == b.n_groups[0] - 1
