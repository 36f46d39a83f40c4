"""Nearest vectors by a block matrix join of int8 product tiles.

Vectors are packed into blocks as they are scanned. A group brings one block of queries
together with one shard of candidates; its tile is a matrix product of int8 codes, exact
in float32. With a scale s and rounding residue r for each vector, <q, c> lies within
s_q s_c <codes> +- (|r_q| |c| + |q~| |r_c|), where q~ is the dequantised query: lower bounds
set, for each query, what its k-th best certainly reaches, and only pairs whose upper bound reaches
it are recomputed, in double precision on the original components in their order. Each
tile keeps the k best of a query in a heap's order, and a last aggregation merges the tiles'
heaps. The search is exact.

Equal vectors of a shard are multiplied once: a query needs no more than its k + 1 smallest ids.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; vectors
meet others of their length only; of repeated vec_ids one vector (the smallest) counts; ties go to the
smaller vec_id; fewer than k candidates give all; no rows give no rows; other columns never matter.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import prepare


@dataclass(frozen=True)
class Tiling:
    """Vectors in a block of queries, and in a shard of candidates; a shard is multiplied ``strip`` candidates at a time."""

    queries: int = 4096
    shard: int = 8192
    strip: int = 4096


def valid_vectors(rows: DataFrame, vec: str) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part, one for each vec_id."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull()).where(finite)
    return good.groupBy("vec_id").agg(F.min(vec).alias("v")).withColumn("dim", F.size("v"))


def packed(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of a task that agree in dim and keys: dim, keys, n, ids, vecs (float64)."""
    schema = ", ".join(["dim int", *(f"{k} int" for k in keys), "n int", "ids binary", "vecs binary"])
    by = ["dim", *keys]

    def run(batches):
        held: dict[tuple, list] = {}

        def block(key):
            ids, vecs = zip(*held.pop(key), strict=True)
            ids, vecs = np.concatenate(ids), np.concatenate(vecs)
            for at in range(0, len(ids), size):
                part = [key[i] for i in range(len(by))], len(ids[at : at + size]), ids[at : at + size].tobytes(), vecs[at : at + size].tobytes()
                cols = [pa.array([x], pa.int32()) for x in part[0]] + [pa.array([part[1]], pa.int32()), pa.array([part[2]], pa.binary()), pa.array([part[3]], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*by, "n", "ids", "vecs"])

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            values = batch.column("v")
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(batch.column("dim").to_numpy(zero_copy_only=False))
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in by], axis=1)
            for key in map(tuple, np.unique(marks, axis=0).tolist() if len(ids) else []):
                at = np.flatnonzero((marks == key).all(axis=1))
                dim = key[0]
                held.setdefault(key, []).append((ids[at], flat[(ends[at] - dim)[:, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in held[key]) >= size:
                    yield from block(key)
        for key in list(held):
            yield from block(key)

    return rows.select("vec_id", "v", *by).mapInArrow(run, schema)


def unpack(frame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(b, np.int64) for b in frame["ids"]])
    return ids, np.concatenate([np.frombuffer(b, np.float64).reshape(-1, dim) for b in frame["vecs"]])


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the dequantised vector, norm of the residue."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(np.float64).tiny  # components too small for a scale: codes are zero, all is residue
    codes = np.clip(np.rint(v / scale[:, None]), -127, 127).astype(np.int8)
    back = codes * scale[:, None]
    slack = 1 + 1e-12  # the bounds' own rounding
    return codes, scale, np.linalg.norm(back, axis=1) * slack, np.linalg.norm(v - back, axis=1) * slack


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def distinct_vectors(ids: np.ndarray, vecs: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each different vector once, and its k + 1 smallest ids."""
    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order], np.ascontiguousarray(vecs[order] + 0.0)  # -0 is 0
    raw = vecs.view(np.dtype((np.void, vecs.dtype.itemsize * vecs.shape[1]))).ravel()
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    by = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group))
    return vecs[first], [ids[by[(ends[g - 1] if g else 0) : ends[g]][: k + 1]] for g in range(len(first))]


def search_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, strip: int) -> dict[str, np.ndarray]:
    """For each query its k best of the candidates: (query_id, vec_id, score), best first."""
    c, members = distinct_vectors(c_ids, c, k)
    qc, qs, qn, qr = quantise(q)
    cc, cs, cn, cr = quantise(c)
    tile_type = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qf = qc.astype(tile_type)
    c_norm = np.linalg.norm(c, axis=1) * (1 + 1e-12)
    floor = np.full(len(q), -np.inf)  # what the k-th best other candidate certainly reaches
    best: list[list[tuple[float, int]]] = [[] for _ in q_ids]  # heaps of (score, -vec_id), the worst on top
    for at in range(0, len(c), strip):
        part = slice(at, at + strip)
        middle = (qf @ cc[part].astype(tile_type).T).astype(np.float64) * qs[:, None] * cs[None, part]
        error = qr[:, None] * c_norm[None, part] + qn[:, None] * cr[None, part]
        error += 1e-12 * np.abs(middle)
        low = middle - error
        if low.shape[1] > k + 1:  # the query itself may be among the candidates
            floor = np.maximum(floor, np.partition(low, low.shape[1] - k - 1, axis=1)[:, low.shape[1] - k - 1])
        rows, cols = np.nonzero(middle + error >= floor[:, None])
        for begin in range(0, len(rows), 1 << 18):
            r, j = rows[begin : begin + (1 << 18)], cols[begin : begin + (1 << 18)] + at
            for row, col, score in zip(r.tolist(), j.tolist(), exact_products(q[r], c[j]).tolist(), strict=True):
                heap, own = best[row], q_ids[row]
                for vec_id in members[col].tolist():
                    if vec_id == own:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -vec_id))
                    elif (score, -vec_id) > heap[0]:
                        heapq.heapreplace(heap, (score, -vec_id))
                    else:
                        break
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in best])
    own = [sorted(h, key=lambda x: (-x[0], -x[1])) for h in best]
    sizes = [len(h) for h in own]
    flat = [x for h in own for x in h]
    return {
        "query_id": np.repeat(q_ids, sizes),
        "vec_id": np.array([-x[1] for x in flat], dtype=np.int64),
        "score": np.array([x[0] for x in flat], dtype=np.float64),
    }


def nearest(rows: DataFrame, is_query, k: int = 20, vec: str = "embedding", tiling: Tiling = Tiling()) -> DataFrame:
    """query_id, rank, vec_id, score of the k candidates with the largest inner product with each query.

    rows: vec_id and ``vec``, an array of numbers. is_query: a condition on vec_id.
    """
    prepare(rows.sparkSession)
    vectors = valid_vectors(rows, vec)
    n = rows.count()
    n_queries = rows.where(is_query).count()
    q_blocks, shards = -(-max(1, n_queries) // tiling.queries), -(-max(1, n) // tiling.shard)
    deal = lambda m, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    queries = packed(vectors.where(is_query).withColumn("qb", deal(q_blocks, 1)), ["qb"], tiling.queries)
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    cands = packed(vectors.withColumn("shard", deal(shards, 2)), ["shard"], tiling.shard)
    cands = cands.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def tile(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        dim = int(key[0])
        return pd.DataFrame(search_tile(*unpack(left, dim), *unpack(right, dim), k, tiling.strip))

    keys = ["dim", "qb", "shard"]
    found = queries.groupBy(*keys).cogroup(cands.groupBy(*keys)).applyInPandas(tile, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
