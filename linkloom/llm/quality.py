"""Quality rules: a base of word counts, and zstandard compression bands over whole texts and fixed chunks.

A text passes the bands if its compression ratio (UTF-8 bytes over compressed bytes) lies
within the limits for its length, and at most ``bad_share`` of its bytes are in fixed chunks that
leave theirs. What is left after the last full chunk is a chunk too, under the limits for its
length. A high ratio means repetition; a low one means encoded or random data.

Defined results: null text has no words and fails the base; empty text likewise; texts of
any length are taken whole; repeated rows are judged alike; other columns never matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from linkloom.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits by length: (bytes below which the row holds, lowest ratio, highest ratio)."""

    whole: tuple[tuple[float, float, float], ...] = (
        (100, 0.0, 2.2),
        (300, 0.8, 2.6),
        (1_000, 1.2, 3.0),
        (3_000, 1.4, 3.4),
        (10_000, 1.5, 3.8),
        (100_000, 1.5, 4.6),
        (float("inf"), 1.5, 6.0),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.3, 3.6)
    bad_share: float = 0.3
    level: int = 3


@dataclass(frozen=True)
class Base:
    min_words: int = 20
    max_repeat_percent: int = 30


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows of eight that occur at least twice; windows are compared exactly, by ranks of 2, 4 and 8 words."""
    n = len(words)
    if n < window:
        return 0
    ids: dict[str, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    width = 1
    while True:
        pair = rank[:-width] * np.int64(n + 1) + rank[width:]
        values, rank, count = np.unique(pair, return_inverse=True, return_counts=True)
        if len(values) == len(pair):
            return 0
        width *= 2
        if width == window:
            break
    begins = np.flatnonzero(count[rank] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines that have a word and equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif WORD.search(line):
            seen.add(line)
    return n


class Compressor:
    """Verdicts of the compression bands; one context is reused for all texts of a task."""

    def __init__(self, bands: Bands):
        self.bands = bands
        self.zstd = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.zstd.compress(data)) if data else 1.0

    def limits(self, n: int) -> tuple[float, float]:
        return next((low, high) for below, low, high in self.bands.whole if n < below)

    def judge(self, data: bytes) -> tuple[float, float, bool]:
        """Ratio of the whole, share of the bytes in chunks outside their limits, and whether the text passes."""
        whole = self.ratio(data)
        low, high = self.limits(len(data))
        step = self.bands.chunk_bytes
        bad = 0
        for at in range(0, len(data), step):
            chunk = data[at : at + step]
            least, most = self.bands.chunk if len(chunk) == step else self.limits(len(chunk))
            bad += 0 if least <= self.ratio(chunk) <= most else len(chunk)
        share = bad / len(data) if data else 0.0
        return whole, share, low <= whole <= high and share <= self.bands.bad_share


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def assess(docs: DataFrame, keep: list[str] = ["doc_id"], base: Base = Base(), bands: Bands = Bands()) -> DataFrame:
    """The columns ``keep``, the base counts, and both verdicts."""
    prepare(docs.sparkSession)
    schema = docs.select(*keep).schema
    for part in SCHEMA.split(", "):
        schema = schema.add(*part.split(" "))
    types = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64())

    def run(batches):
        zstd = Compressor(bands)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                words = WORD.findall(text)
                n, rep = len(words), repeated_words(words)
                failed = n < base.min_words or 100 * rep > base.max_repeat_percent * n
                ratio, share, good = zstd.judge(text.encode("utf-8", "surrogatepass"))
                rows.append((n, sum(map(len, words)), len(SYMBOL.findall(text)), duplicate_lines(text), rep, failed, good and not failed, ratio, share))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
