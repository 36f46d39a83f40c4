"""Operator 9 held to a similarity: near-duplicates by the exact Jaccard similarity of word shingles.

A text is the set of its shingles of ``shingle`` words (ASCII letters in lower case; a shorter text is one shingle).
Two texts are linked if the similarity of their sets is at least ``least``; texts of equal sets are one node.
Candidates come from two sources, and each is compared exactly, so no link is wrong:

* The SimHash fingerprints of these shingles, by op9's Golay keys. Alone they can't do it: at a similarity of 0.8
  about ten of 64 bits differ, where the keys vouch for two.
* BANDS keys of ROWS minima. A pair of similarity s shares none with probability (1 - s^ROWS)^BANDS: 3 in a million
  at 0.8, less above.

First each set is compared with one other, the least that it shares a key with. A key all of whose sets are linked to
one set is settled, whatever its size. Of the others, keys of at most ``bucket_cap`` sets give pairs, and the sets of
larger ones are compared in one go, of which a star for each component comes back. Keys of more than BLOCK sets go by
pivots first: those that a pivot links need no more comparison with each other, and as 1 - similarity is a metric, none
with a set that is much farther from the pivot than they are. Pivots go on while each links at least GAIN of the sets
of a key that none has linked yet; in a loose group they would link next to none. What that leaves is dealt into blocks
of at most about BLOCK, and every two blocks are compared in one go. So nothing is left out, no row is made for each
pair of a large group, and no task has to hold a whole group.

Defined results: null text and text without words are one node without keys; a null doc_id gets the component of
its text; no rows give no rows; other columns never matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from linkloom.llm.common import cut, join_hot, prepare, rows_in
from linkloom.llm.components import components
from linkloom.llm import simhash
from linkloom.llm.simhash import SEED

SHINGLE = 5
LEAST = 0.8
BANDS = 32
ROWS = 5
BLOCK = 1024
PIVOTS = 4
GAIN = 0.1
TILE = 4096


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    return distinct(simhash.digests(text, shingle))


def distinct(digests: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(digests), dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    return draw(BANDS * ROWS) | np.uint64(1), draw(BANDS * ROWS), (draw(BANDS * ROWS) | np.uint64(1)).reshape(BANDS, ROWS)


def band_keys(own: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes (signed 64-bit); none of an empty set."""
    if not len(own):
        return np.zeros(0, dtype=np.int64)
    factor, term, mix = _constants()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), 8192):
        np.minimum(least, (own[at : at + 8192, None] * factor + term).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * mix).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, node (hash of the set), n (its size), fp (SimHash) and keys of every row."""
    schema = docs.select("doc_id").schema.add("text_hash", "long").add("node", "long").add("n", "integer").add("fp", "long").add("keys", ArrayType(LongType()))

    def run(batches):
        for batch in batches:
            all_ = [simhash.digests(t.as_py(), shingle) for t in batch.column("text")]
            sets = [distinct(d) for d in all_]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            cols = [batch.column("doc_id"), batch.column("text_hash"), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array([simhash.majority(d) for d in all_], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, own: the hashes as bytes) of wanted (node, text_hash)."""

    def run(batches):
        for batch in batches:
            own = [shingles(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], names=["node", "own"])

    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(wanted, "text_hash")
    return texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node long, own binary")


def block_links(sets: list[np.ndarray], side: np.ndarray, least: float) -> np.ndarray:
    """For each set the least place that links lead to; only sets of different sides are compared, or all if there is one."""
    size = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(at, minlength=len(values)) > 1  # what one set alone has is in no intersection
    column = np.cumsum(often) - 1
    row, column = row[often[at]], column[at][often[at]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)  # whole numbers below 2^24, exact
    for low in range(0, int(often.sum()), TILE):
        part = slice(*np.searchsorted(column, (low, low + TILE)))
        tile = np.zeros((len(sets), TILE), dtype=np.float32)
        tile[row[part], column[part] - low] = 1
        both += tile @ tile.T
    near = both / (size[:, None] + size[None, :] - both.astype(np.float64)) >= least
    if len(set(side.tolist())) > 1:
        near &= side[:, None] != side[None, :]
    root = np.full(len(sets), -1)
    for first in range(len(sets)):
        front = np.array([first]) if root[first] < 0 else np.zeros(0, dtype=int)
        while len(front):
            root[front] = first
            front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
    return root


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with ``s``, their similarity. A node may be ``a`` in any number of pairs, and ``b`` in as many as it has keys."""

    def run(batches):
        for batch in batches:
            own = [[np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(c)] for c in ("own_a", "own_b")]
            s = pa.array([jaccard(a, b) for a, b in zip(*own, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), s], names=["a", "b", "s"])

    pairs = cut(pairs)
    left, right = (sets.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
    left = pairs.groupBy("a").agg(F.count("*").alias("n_pairs")).join(left, "a")
    # The many sides' sets meet the pairs first, while these are narrow.
    met = join_hot(pairs.join(right, "b"), left, ["a"], "n_pairs", total=rows_in(pairs))
    return met.select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long, s double")


def _crowd_links(crowd: DataFrame, sets: DataFrame, least: float) -> list[DataFrame]:
    """Links (a, b) within the keys of crowd (key, node): stars around pivots, then whatever these leave, in blocks."""
    found, rest = [], []
    crowd = cut(crowd.select("key", "node", F.lit(True).alias("free")))
    loose = F.when(F.col("s") < least, F.col("s"))
    for _ in range(PIVOTS):
        if not (total := rows_in(crowd)):
            break
        # The smallest node that no pivot before has linked. Keys of one group have one pivot, so its stars are one too.
        free = F.when(F.col("free"), F.col("node"))
        pivots = crowd.groupBy("key").agg(F.min(free).alias("pivot"), F.count("*").alias("n"))
        held = cut(join_hot(crowd, pivots, ["key"], "n", total=total).drop("n"))
        pairs = held.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        near = cut(_similarities(pairs, sets))
        found.append(near.where(F.col("s") >= least).select("a", "b"))
        held = cut(held.join(near.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "s"), ["pivot", "node"]).select("key", "node", "free", "s"))
        still = F.count_if(loose.isNotNull() & F.col("free"))
        more = (still > 0) & (still <= (1 - GAIN) * F.count_if("free"))
        far = held.groupBy("key").agg(F.max(loose).alias("most"), more.alias("more"), F.count("*").alias("n"))
        # A set at 1 - s from the pivot may be within 1 - least only of what is at most that much farther away.
        left = join_hot(held, far.where("most IS NOT NULL"), ["key"], "n", total=total).where(F.col("s") <= F.col("most") + (1 - least) + 1e-9)
        left = cut(left.select("key", "node", (F.col("free") & (F.col("s") < least)).alias("free"), "more"))
        # Where all are linked to some pivot, members of different pivots' stars may still be linked. Loose sets are left to blocks.
        rest.append(left.where("NOT more").select("key", "node"))
        crowd = left.where("more").select("key", "node", "free")
    else:
        rest.append(crowd.select("key", "node"))
    if not rest:
        return found
    crowd = rest[0]
    for more in rest[1:]:
        crowd = crowd.union(more)
    crowd = cut(crowd)
    counts = crowd.groupBy("key").agg(F.count("*").alias("count")).where("count > 1")
    return [*found, _block_links(join_hot(crowd, counts, ["key"], "count", total=rows_in(crowd)), sets, least)]


def _block_links(crowd: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links within the keys of crowd (key, node, count), by blocks."""
    parts = F.ceil(F.col("count") / BLOCK).cast("int")
    placed = crowd.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64("node", "key"), F.col("_parts")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # With one other block each; a block by itself is compared with itself.
    placed = placed.select("key", "node", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        root = block_links([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("own")], table.column("_own").to_numpy(), least)
        keep = root != np.arange(len(root))
        return pa.table({"a": node[root[keep]], "b": node[keep]})

    held = placed.join(sets, "node")
    return held.groupBy("key", "_i", "_j").applyInArrow(run, "a long, b long")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) by op9's keys: stars of the nodes of a fingerprint, and one pair for each two linked fingerprints."""
    fps = cut(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("size")))
    # A node that is alone with its fingerprint makes no star.
    stars = join_hot(nodes.select("fp", "node"), fps.where("size > 1"), ["fp"], "size").select(F.col("first").alias("a"), F.col("node").alias("b"))
    left, right = (fps.select(F.col("fp").alias(f"fp_{c}"), F.col("first").alias(c)) for c in "ab")
    # Of links a fingerprint has at most as many as its keys have room for, or is the least at the words where it meets others.
    links = simhash.links(fps).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    linked = links.join(left, "fp_a").join(right, "fp_b")
    return stars.union(linked.select("a", "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _unsettled(near: DataFrame, first: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, count) of the keys of near (key, node) whose sets ``found`` doesn't link to one; first: (node, a), the set each was compared with."""
    linked = first.join(found.select("a", F.col("b").alias("node"), F.lit(True).alias("linked")), ["a", "node"], "left")
    label = cut(linked.select("node", F.when(F.col("linked"), F.col("a")).otherwise(F.col("node")).alias("label")))
    # The one that a set is linked to may be linked to another itself.
    sizes = label.groupBy("label").agg(F.count("*").alias("n"))
    further = sizes.join(label.select(F.col("node").alias("label"), F.col("label").alias("end")), "label")
    label = join_hot(label, further, ["label"], "n", total=rows_in(label)).select("node", "end")
    mixed = near.join(label, "node").groupBy("key").agg(F.count("*").alias("count"), F.min("end").alias("low"), F.max("end").alias("high"))
    return join_hot(near, mixed.where("low <> high").select("key", "count"), ["key"], "count")


def links(nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, bucket_cap: int = 4) -> DataFrame:
    """Links (a, b) that connect nodes (node, text_hash, n, fp, keys) as their similarities do."""
    keys = nodes.select("node", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("count")).where("count > 1"))
    near = cut(join_hot(keys, shared, ["key"], "count"))
    first = cut(near.groupBy("node").agg(F.min("a").alias("a")))
    near = near.select("key", "node")
    by_fingerprint = cut(_fingerprint_pairs(nodes))
    wanted = first.select("node").union(by_fingerprint.select("a")).union(by_fingerprint.select("b")).distinct()
    sets = cut(sets_of(docs, nodes.join(wanted, "node", "left_semi").select("node", "text_hash"), shingle))
    pairs = first.where("a <> node").select("a", F.col("node").alias("b")).union(by_fingerprint.select("a", "b")).distinct()
    found = cut(_similarities(pairs, sets).where(F.col("s") >= least).select("a", "b"))
    rest = cut(_unsettled(near, first, found))
    few = rest.where(F.col("count") <= bucket_cap)
    left, right = (few.select("key", F.col("node").alias(c)) for c in "ab")
    pairs = left.join(right, "key").where("a < b").select("a", "b").distinct()
    found = found.union(_similarities(pairs, sets).where(F.col("s") >= least).select("a", "b"))
    found = found.union(_block_links(rest.where((F.col("count") > bucket_cap) & (F.col("count") <= BLOCK)), sets, least))
    for more in _crowd_links(rest.where(F.col("count") > BLOCK), sets, least):
        found = found.union(more)
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, bucket_cap: int = 4) -> DataFrame:
    """doc_id, text_hash, component_id (smallest doc_id that links reach) and root (the component's own number) of each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    rows = cut(signatures(docs, shingle))
    first = [F.first(c).alias(c) for c in ("n", "fp", "keys")]
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.count("*").alias("n_rows"), *first))
    roots = components(links(nodes, docs, shingle, least, bucket_cap))
    linked = cut(nodes.select("node", "least").join(roots, "node"))
    sizes = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    found = join_hot(linked.select("node", "root"), sizes, ["root"], "size", total=rows_in(linked))
    named = nodes.select("node", "least", "n_rows").join(found, "node", "left")
    named = cut(named.select("node", "n_rows", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))
    return join_hot(rows.select("doc_id", "text_hash", "node"), named, ["node"], "n_rows").select("doc_id", "text_hash", "component_id", "root")
