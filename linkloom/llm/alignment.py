"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other.

Both tokenizers must give back the bytes of a blank and the text. Ends of tokens are cumulative sums of their byte
lengths; places where tokens of both end cut a text into groups; a token of one is linked with every token of the other
that shares a byte with it. A task aligns a block of documents at once, by NumPy over the whole block.

How many documents of the corpus hold a linked pair of ids is counted over (block, pair): a block gives each
of its distinct pairs once, with the number of its documents that hold it. These are added up in two shuffles, first
for each pair and salt, then for each pair. Counts go back to the blocks the same way, pair by pair, and every block
meets its documents again, which were written once. What moves grows with the distinct pairs of blocks, not with links.

Defined results: null and empty text, and text that a tokenizer doesn't give back byte for byte, has no tokens: zeros and
an empty groups_sha256. Special tokens' strings are plain text. Repeated rows count as often as they occur; a null doc_id
stays null; no rows give no rows; other columns never matter, whatever their names. A pair is best if no pair of its first
id is held by more documents; ties are all best. Texts of any length are tokenised whole; a text longer than a block is one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut, join_hot, prepare, spool

BLOCK_CHARS = 3_000_000
SALTS = 16
A_BITS = 32  # a pair's code holds the first id above so many bits


@dataclass(frozen=True)
class Vocabularies:
    """Names of two vocabulary files: byte-level ranks, and a sentencepiece model that puts a blank first."""

    a: str = "byte_bpe_50k.tiktoken"
    b: str = "piece_bpe_32k.model"


class Tokenizers:
    """Ids of texts by both tokenizers, and every id's bytes."""

    def __init__(self, names: Vocabularies):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(names.a), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("linkloom-a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        self.pieces = sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(names.b))
        self.bytes_b = [self._piece(sp, i) for i in range(sp.get_piece_size())]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        n = max(len(self.bytes_a), len(self.bytes_b))
        #: The decimal ids, each with the sign that follows it: an id of the same side, the other side, the next group.
        self.names = [f"{i}{sign}" for sign in ",|;" for i in range(n)]
        self.n_names = n

    @staticmethod
    def _piece(sp, i: int) -> bytes:
        piece = sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """(A's ids, B's ids) of each text; both empty where there is no text or the bytes aren't given back."""
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1) if texts else [], strict=True):
            whole = f" {text}".encode()
            a = self.encoding.encode_ordinary(f" {text}") if text else []
            same = bool(text) and b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            yield (a, b) if same else ([], [])


@dataclass
class Block:
    """What a block of documents gives: columns by document, and its distinct pairs."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    codes: np.ndarray  # distinct pairs, sorted
    held: np.ndarray  # by how many documents
    starts: np.ndarray  # where each document's pairs start, and the end
    pairs: np.ndarray  # their places in codes, ascending within a document
    times: np.ndarray  # how many links of the document each stands for


def align(tokens: Tokenizers, texts: list[str]) -> Block:
    n = len(texts)
    both = list(tokens.ids(texts))
    n_a, n_b = (np.array([len(x[side]) for x in both], np.int64) for side in (0, 1))
    ids_a, ids_b = (np.fromiter((i for x in both for i in x[side]), np.int64, count=int(total.sum())) for side, total in ((0, n_a), (1, n_b)))
    del both
    # Documents lie end to end: all end where both have an end, so no group and no link leaves its document.
    ends_a, ends_b = np.cumsum(tokens.sizes_a[ids_a]), np.cumsum(tokens.sizes_b[ids_b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    last_a = np.cumsum(n_a)  # each document's end among A's tokens
    doc_a = np.repeat(np.arange(n), n_a)
    n_groups = np.diff(np.concatenate([[0], np.where(last_a > 0, group_a[last_a - 1] + 1, 0)])) if len(cuts) else np.zeros(n, np.int64)
    # Tokens in the order of their groups, A's before B's.
    side = np.concatenate([group_a * 2, group_b * 2 + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    sign = np.ones(len(side), np.int64)
    sign[:-1] = side[:-1] != side[1:]
    names = tokens.names
    said = [names[i] for i in (np.concatenate([ids_a, ids_b])[order] + sign * (1 + (side & 1)) * tokens.n_names).tolist()]
    at = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    groups = ["".join(said[i:j])[:-1] for i, j in zip(at[:-1], at[1:], strict=True)]
    del side, order, sign, said
    # Links: the B tokens from the first that ends after an A token's start to the first that ends at its end or later.
    first = np.searchsorted(ends_b, ends_a - tokens.sizes_a[ids_a], side="right")
    count = np.searchsorted(ends_b, ends_a, side="left") - first + 1
    whose = np.repeat(np.arange(len(ids_a)), count)
    other = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count) + first[whose]
    codes, place = np.unique(ids_a[whose] << A_BITS | ids_b[other], return_inverse=True)
    keys, times = np.unique(doc_a[whose] * max(1, len(codes)) + place, return_counts=True)
    docs, pairs = np.divmod(keys, max(1, len(codes)))
    return Block(
        n_a, n_b, n_groups, np.bincount(doc_a[whose], minlength=n), groups, codes, np.bincount(pairs, minlength=len(codes)),
        np.searchsorted(docs, np.arange(n + 1)), pairs.astype(np.uint32), times.astype(np.uint32),
    )


def aligned(docs: DataFrame, names: Vocabularies = Vocabularies(), with_groups: bool = False) -> DataFrame:
    """Every document's counts and pairs, written once; the first row of a block also has the block's distinct pairs."""
    prepare(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("block", "long")
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("groups", "string").add("pairs", "binary").add("times", "binary").add("codes", "binary").add("held", "binary")

    def give(tokens: Tokenizers, block: int, ids: list, texts: list[str]) -> pa.RecordBatch:
        b = align(tokens, texts)
        binary = lambda parts: pa.array([p.tobytes() for p in parts], pa.binary())
        cuts = b.starts[1:-1]
        steps = [np.diff(p, prepend=np.uint32(0)) for p in np.split(b.pairs, cuts)]
        only_first = lambda x: pa.array([x.tobytes(), *[None] * (len(texts) - 1)], pa.binary())
        whole = pa.concat_arrays(ids)
        columns = [
            whole, pa.array(np.full(len(texts), block)), *(pa.array(x) for x in (b.n_a, b.n_b, b.n_groups, b.n_links)),
            pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in b.groups], pa.string()),
            pa.array(b.groups if with_groups else [None] * len(texts), pa.string()), binary(steps), binary(np.split(b.times, cuts)),
            only_first(b.codes), only_first(b.held.astype(np.int64)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches):
        tokens = None
        block = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            tokens = tokens or Tokenizers(names)
            begin = 0
            for k, text in enumerate(batch.column("text")):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BLOCK_CHARS:
                    yield give(tokens, block, [*ids, batch.column("doc_id").slice(begin, k + 1 - begin)], texts)
                    block, ids, texts, size, begin = block + 1, [], [], 0, k + 1
            ids.append(batch.column("doc_id").slice(begin))
        if texts:
            yield give(tokens, block, ids, texts)

    return spool(docs.select("doc_id", "text").mapInArrow(run, schema), "aligned")


def block_pairs(written: DataFrame) -> DataFrame:
    """block, a, b, held: the distinct pairs of each block and how many of its documents hold them."""

    def run(batches):
        for batch in batches:
            for block, codes, held in zip(*(batch.column(c) for c in ("block", "codes", "held")), strict=True):
                own = np.frombuffer(codes.as_py(), np.int64)
                columns = [np.full(len(own), block.as_py()), (own >> A_BITS).astype(np.int32), (own & (2**A_BITS - 1)).astype(np.int32), np.frombuffer(held.as_py(), np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "a", "b", "held"])

    return written.where(F.col("codes").isNotNull()).select("block", "codes", "held").mapInArrow(run, "block long, a int, b int, held long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, docs, blocks, best: by how many documents and blocks each pair is held, and whether none of its a has more."""
    salted = pairs.groupBy("a", "b", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("held").alias("held"), F.count("*").alias("blocks"))
    counts = salted.groupBy("a", "b").agg(F.sum("held").alias("docs"), F.sum("blocks").alias("blocks"))
    # A window holds the pairs of one id of A: at most B's vocabulary.
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def report(docs: DataFrame, names: Vocabularies = Vocabularies(), with_groups: bool = False) -> DataFrame:
    """Per document its tokens, groups and links, and how common the linked pairs are in the corpus."""
    written = aligned(docs, names, with_groups)
    pairs = block_pairs(written)
    counts = cut(pair_counts(pairs))
    known = join_hot(pairs.select("block", "a", "b"), counts.select("a", "b", "docs", "best", "blocks"), ["a", "b"], "blocks").select("block", "a", "b", "docs", "best")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    schema = written.select("doc_id").schema
    for name in out[1:7]:
        schema = schema.add(name, "long")
    for name in out[7:]:
        schema = schema.add(name, "string")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        code = right.column("a").to_numpy().astype(np.int64) << A_BITS | right.column("b").to_numpy()
        order = np.argsort(code)
        docs_of, best = right.column("docs").to_numpy()[order], right.column("best").to_numpy()[order]
        n_best, total = [], []
        for steps, times in zip(left.column("pairs"), left.column("times"), strict=True):
            at = np.cumsum(np.frombuffer(steps.as_py(), np.uint32), dtype=np.int64)
            n = np.frombuffer(times.as_py(), np.uint32).astype(np.int64)
            n_best.append(int(n[best[at]].sum()) if len(at) else 0)
            total.append(int((n * docs_of[at]).sum()) if len(at) else 0)
        found = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table({name: found[name] if name in found else left.column(name) for name in out})

    rows = written.select("block", *(c for c in out if c not in ("n_best", "count_sum")), "pairs", "times")
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(sums, schema)
