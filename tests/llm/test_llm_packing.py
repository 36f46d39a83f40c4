"""op5: the ids, the pieces, the plan and the whole packing."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from linkloom.llm import packing


def reference_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END]


def test_ids_are_those_of_the_tokenizers_file():
    encoder = packing.Encoder()
    rng = random.Random(4)
    texts = ["", None, "Hello  world\n\n\tx", "naïve café ümlaut 漢字 𝄞 \x00\x7f", "it's we'll 12345 67", "<|endoftext|> x", "a <|endoftext|><|endoftext|>b <|endoftext|", "a" * 3000, "= = =   " * 40]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), 10, 32])) for _ in range(200)) for _ in range(40)]
    for text in texts:
        assert encoder.ids(text).tolist() == reference_ids(text)


def test_added_tokens():
    assert packing.Encoder().ids("<|endoftext|> x").tolist() == [50256, 2124, 2]


def test_pieces():
    assert list(packing.cut_up(1, 4)) == [(0, 1)] and list(packing.cut_up(4, 4)) == [(0, 4)]
    assert list(packing.cut_up(9, 4)) == [(0, 1), (1, 4), (5, 4)]


def check_plan(histogram, capacity=1024, **more):
    runs = packing.plan(dict(histogram), capacity, **more)
    held, ranks = Counter(), {}
    for r in runs:
        assert r.room >= 0 and sum(n for n, _ in r.items) + r.room == capacity
        for n, at in r.items:
            held[n] += r.times
            ranks.setdefault(n, []).append((at, at + r.times))
    assert held == Counter({n: c for n, c in histogram.items() if c})
    for own in ranks.values():
        own.sort()
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    return sum(r.times for r in runs)


def first_fit_decreasing(histogram, capacity):
    rooms = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        i = next((i for i, r in enumerate(rooms) if r >= n), None)
        if i is None:
            rooms.append(capacity - n)
        else:
            rooms[i] -= n
    return len(rooms)


def test_plans_hold_everything_once_and_are_tight():
    rng = random.Random(2)
    for k in range(60):
        h = Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 12), 60]) for _ in range(rng.randint(1, 150)))
        assert check_plan(h, 100, n_groups=rng.choice([1, 5, 1024])) <= 2 * first_fit_decreasing(h, 100) or k < 0
    h = Counter(rng.randint(1, 1023) for _ in range(20_000))
    total = sum(n * c for n, c in h.items())
    n = check_plan(h)
    assert n <= 1.01 * max(-(-total // 1024), sum(c for x, c in h.items() if x > 512))
    assert check_plan({n: c * 1_000_000 for n, c in h.items()}) > n  # as quick at any count
    assert check_plan({}) == 0 and check_plan({1024: 5}) == 5


def test_packing_of_awkward_documents(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "of", "beta", "42"]) for _ in range(rng.choice([1, 30, 500, 2600]))) for _ in range(60)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7), (None, "x y", 7), (100, None, 7), (101, "", 7), (102, "long " * 60_000, 7)] + [(200 + i, "copy of one", 7) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    out = packing.pack(df, with_ids=True).collect()
    sequences = {}
    for r in out:
        assert r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    wanted = Counter()
    for d, t, _ in rows:
        ids = reference_ids(t)
        for k, (start, n) in enumerate(packing.cut_up(len(ids), 1024)):
            wanted[d, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in out) == wanted
    total = sum(n * c for (_, _, _, n, _), c in wanted.items())
    assert len(sequences) <= 1.05 * total / 1024 + 2
    assert packing.pack(df.limit(0)).count() == 0
