"""Near-duplicates by 64-bit SimHash, with Golay-code fuzzy hashing as the candidate search.

The fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits. Two
fingerprints that differ in at most two bits agree in at least one segment (pigeonhole)
and differ in at most two bits in the segment after it. That second segment, padded to 23
bits, is decoded to all codewords of the binary Golay code within distance four: one or six
of them, and words at distance two always share one. A key is (segment number, the segment
that agrees, index of a codeword of the next), so every link shares a key. Rows that
share a key are joined and their distance is verified.

Keys that more than ``bucket_cap`` distinct fingerprints share are not paired. Their
fingerprints go another exact way: each is sent to itself and the 64 words at distance one;
words at distance two or less meet at such a word, where at most 65 distinct fingerprints
can be, and each is linked to the smallest there. So no link is lost and no group is large.

Defined results: null text and text without words have fingerprint zero and are linked
like any other; equal texts share a fingerprint; no rows give no rows; a null doc_id gets
the component of its fingerprint; other columns never matter.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import cut, join_hot, prepare, rows_in
from linkloom.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: (lowest bit, width) of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
GOLAY_POLY = 0b101011100011  # generator of the (23, 12) code
GOLAY_RADIUS = 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def golay_syndrome(word: np.ndarray | int):
    """Remainder of the 23-bit word divided by the generator: 11 bits."""
    w = np.array(word, dtype=np.int64)
    for bit in range(22, 10, -1):
        w = np.where(w >> bit & 1, w ^ (GOLAY_POLY << (bit - 11)), w)
    return w


def _golay_table() -> np.ndarray:
    """For each syndrome, the error patterns of at most GOLAY_RADIUS bits that have it; -1 fills up."""
    patterns = [sum(1 << b for b in bits) for n in range(GOLAY_RADIUS + 1) for bits in combinations(range(23), n)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for pattern, s in zip(patterns, golay_syndrome(np.array(patterns)), strict=True):
        found[s].append(pattern)
    table = np.full((2048, max(map(len, found))), -1, dtype=np.int64)
    for s, own in enumerate(found):
        table[s, : len(own)] = own
    return table


_TABLE: np.ndarray | None = None


def golay_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word, the 12-bit indices of the codewords within GOLAY_RADIUS; -1 fills up."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _golay_table()
    errors = _TABLE[golay_syndrome(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, key) of all keys of the fingerprints (signed 64-bit)."""
    u = fps.astype(np.int64).view(np.uint64)
    parts = [((u >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        indices = golay_indices(parts[(i + 1) % 3])
        row, col = np.nonzero(indices >= 0)
        rows.append(row)
        keys.append((np.int64(i) << 34) | (parts[i][row] << 12) | indices[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included."""
    return majority(digests(text, shingle))


def digests(text: str | None, shingle: int) -> list[bytes]:
    """XXH64 of the text's word shingles, repeats included, as eight bytes each."""
    words = words_of(text)
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) < shingle:
        return [digest(joined, SEED)]
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    begin = starts[: len(words) - shingle + 1].tolist()
    end = (starts[shingle:] - 1).tolist()
    return [digest(joined[b:e], SEED) for b, e in zip(begin, end, strict=True)]


def majority(hashes: list[bytes]) -> int:
    """Each bit that over half of the hashes have, as a signed number."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.frombuffer(b"".join(hashes[at : at + 65536]), dtype=np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
    bits = np.packbits(votes * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed long."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches):
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), fps], names=[*keep, "fp"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def golay_keys(nodes: DataFrame) -> DataFrame:
    """(key, fp): one row for each key of each fingerprint."""

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key = fingerprint_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def links(nodes: DataFrame, bucket_cap: int = 64) -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect exactly what lies within MAX_BITS bits."""
    keys = golay_keys(nodes)
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(join_hot(keys, shared, ["key"], "n"))
    near = met.where(F.col("n") <= bucket_cap)
    left, right = near.select("key", F.col("fp").alias("a")), near.select("key", F.col("fp").alias("b"))
    small = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    crowded = met.where(F.col("n") > bucket_cap).select("fp").distinct()
    return small.union(meeting_links(crowded)).distinct()


def meeting_links(nodes: DataFrame) -> DataFrame:
    """The same for few or many fingerprints, by the words at distance one at which they meet."""
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    met = nodes.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    group = met.groupBy("word").agg(F.collect_list("fp").alias("own")).where(F.size("own") > 1)
    return group.select(F.array_min("own").alias("a"), F.explode("own").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, bucket_cap: int = 64) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach) of each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(nodes, bucket_cap)).withColumnRenamed("node", "fp")
    # Fingerprints without a link are their own component; only the others meet by their root.
    linked = cut(roots.join(nodes.select("fp", "least"), "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    found = join_hot(linked.select("fp", "root"), least, ["root"], "size", total=rows_in(linked)).select("fp", F.col("component_id").alias("found"))
    named = cut(nodes.join(found, "fp", "left").select("fp", "n", F.coalesce("found", "least").alias("component_id")))
    return join_hot(fps, named, ["fp"], "n").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
