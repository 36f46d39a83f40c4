"""Best-fit packing of tokenised documents by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of at most ``capacity``
entries says all that a packing needs, at any corpus size. On the driver the plan is made
from it: large lengths, sorted, are dealt into groups of equal cardinality and rounded up
to their group's largest; configurations of these few sizes are found one after another by
a knapsack over what is left, each repeated as often as it can be; then the actual lengths take
the places of the rounded ones, and small lengths go, longest first, where they fit best.
The plan is a list of runs: so many sequences alike, whose k-th place holds the pieces of one
length with consecutive ranks. On the executors every piece gets its rank among the
pieces of its length, and looks up its run.

A document is its ids, then ``END``. One that is longer than the capacity is cut from its
end into full pieces; its first piece takes the rest.

Defined results: null and empty text are the end id alone; documents of any length are
tokenised whole; a repeated row is packed as often as it occurs; a null doc_id stays null;
no rows give no rows; other columns never matter.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut, prepare

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k"
GROUPS = 512  # fewer than the lengths there can be: one length of three gets rounded up
MAX_PLAN = 1_000_000  # rows of a plan; what lengths a capacity allows bounds them, whatever the corpus


@dataclass(frozen=True)
class Run:
    """``times`` sequences alike; sequence j holds, for each (length, rank), the piece of that length with rank + j."""

    times: int
    items: tuple[tuple[int, int], ...]
    room: int

    def split(self, at: int) -> tuple[Run, Run]:
        later = tuple((length, rank + at) for length, rank in self.items)
        return Run(at, self.items, self.room), Run(self.times - at, later, self.room)

    def plus(self, length: int, rank: int) -> Run:
        return Run(self.times, (*self.items, (length, rank)), self.room - length)


def groups_of(lengths: list[tuple[int, int]], n_groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded length, its actual (length, count)) of groups of equal cardinality; lengths come largest first."""
    total = sum(c for _, c in lengths)
    size = -(-total // max(1, n_groups))
    groups, own, left = [], [], size
    for length, count in lengths:
        while count:
            take = min(count, left)
            own.append((length, take))
            count, left = count - take, left - take
            if not left:
                groups.append((own[0][0], own))
                own, left = [], size
    return groups + ([(own[0][0], own)] if own else [])


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {place in sizes: how many}) that use up all counts.

    Each starts with the largest size left and fills the rest by a bounded knapsack; it is
    repeated until one of its sizes runs out.
    """
    left, found = list(counts), []
    while True:
        head = next((i for i, c in enumerate(left) if c), None)
        if head is None:
            return found
        use = {head: 1}
        room = capacity - sizes[head]
        # reach[s]: the place whose size was added last to come to s, or -1; larger sizes are tried first.
        reach = np.full(room + 1, -1, dtype=np.int64)
        reach[0] = len(sizes)
        for i in range(head, len(sizes)):
            most = left[i] - (i == head)
            if sizes[i] > room or most <= 0:
                continue
            for _ in range(min(most, room // sizes[i])):
                fresh = np.flatnonzero((reach[: room + 1 - sizes[i]] >= 0) & (reach[sizes[i] :] < 0))
                if not len(fresh):
                    break
                reach[fresh + sizes[i]] = i
            if reach[room] >= 0:
                break
        at = int(np.flatnonzero(reach >= 0)[-1])
        while at:
            i = int(reach[at])
            use[i] = use.get(i, 0) + 1
            at -= sizes[i]
        times = min(left[i] // n for i, n in use.items())
        for i, n in use.items():
            left[i] -= n * times
        found.append((times, use))


def _place(runs: dict[int, list[Run]], length: int, count: int, rank: int, capacity: int) -> None:
    """Puts ``count`` pieces of one length where they fit best; runs are by their room."""
    while count:
        room = next((r for r in range(length, capacity) if runs.get(r)), None)
        if room is None:
            per = capacity // length
            times, rest = divmod(count, per)
            if times:
                items = tuple((length, rank + k * times) for k in range(per))
                runs.setdefault(capacity - per * length, []).append(Run(times, items, capacity - per * length))
            if rest:
                at = rank + per * times
                runs.setdefault(capacity - rest * length, []).append(Run(1, tuple((length, at + k) for k in range(rest)), capacity - rest * length))
            return
        run = runs[room].pop()
        if run.times > count:
            run, other = run.split(count)
            runs[room].append(other)
        runs.setdefault(room - length, []).append(run.plus(length, rank))
        count, rank = count - run.times, rank + run.times


def plan(histogram: dict[int, int], capacity: int = CAPACITY, n_groups: int = GROUPS, small: int | None = None) -> list[Run]:
    """Runs that hold every piece once. ``small``: lengths up to it are best-fitted at the end (a quarter of the capacity)."""
    small = capacity // 4 if small is None else small
    ranks = dict.fromkeys(histogram, 0)

    def take(length: int, count: int) -> int:
        ranks[length] += count
        return ranks[length] - count

    runs: dict[int, list[Run]] = {}
    if histogram.get(capacity):
        runs[0] = [Run(histogram[capacity], ((capacity, take(capacity, histogram[capacity])),), 0)]
    large = sorted(((n, c) for n, c in histogram.items() if small < n < capacity and c), reverse=True)
    groups = groups_of(large, n_groups)
    stock = [list(own) for _, own in groups]
    sizes: list[int] = []
    members: list[list[int]] = []  # groups that were rounded to the same length are one size
    for g, (rounded, _) in enumerate(groups):
        if sizes and sizes[-1] == rounded:
            members[-1].append(g)
        else:
            sizes.append(rounded)
            members.append([g])
    pools = [[x for g in own for x in stock[g]] for own in members]
    for times, use in configurations(sizes, [sum(c for _, c in pool) for pool in pools], capacity):
        places = [i for i, n in sorted(use.items()) for _ in range(n)]
        filled: list[list[tuple[int, int, int]]] = []  # per place: (length, first rank, count) that add up to times
        for i in places:
            need, own = times, []
            while need:
                length, count = pools[i][0]
                n = min(need, count)
                own.append((length, take(length, n), n))
                pools[i][0] = (length, count - n)
                if n == count:
                    pools[i].pop(0)
                need -= n
            filled.append(own)
        cuts = sorted({int(x) for own in filled for x in np.cumsum([n for _, _, n in own])})
        begin = 0
        for end in cuts:
            items = []
            for own in filled:
                at = 0
                for length, rank, n in own:
                    if at <= begin < at + n:
                        items.append((length, rank + begin - at))
                        break
                    at += n
            room = capacity - sum(length for length, _ in items)
            runs.setdefault(room, []).append(Run(end - begin, tuple(items), room))
            begin = end
    for length, count in sorted(((n, c) for n, c in histogram.items() if 0 < n <= small and c), reverse=True):
        _place(runs, length, count, take(length, count), capacity)
    return [run for own in runs.values() for run in own]


def lookup(runs: list[Run]) -> dict[str, np.ndarray]:
    """Arrays sorted by (length, rank): where a range of ranks begins, its first sequence, its offset."""
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, rank in run.items:
            rows.append((length, rank, sequence, offset))
            offset += length
        sequence += run.times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


class Encoder:
    """Ids of the tokenizers file ``name``.json, its added tokens included. Its ranks in tiktoken's form give the
    same ids (a test holds them to the tokenizers library) at several times the speed."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        ranks = {token: rank for token, rank in ranks.items() if rank not in added.values()}
        self.encoding = tiktoken.Encoding("linkloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str | None) -> np.ndarray:
        return np.append(np.array(self.encoding.encode(text or "", allowed_special="all"), dtype=np.uint32), np.uint32(END))


def cut_up(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = (n - 1) % capacity + 1
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document of docs (doc_id, text)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    if with_ids:
        from pyspark.sql.types import ArrayType, IntegerType

        schema = schema.add("ids", ArrayType(IntegerType()))
        types.append(pa.list_(pa.int32()))

    def run(batches):
        encoder = Encoder()
        for batch in batches:
            own, rows = [], []
            for d, text in enumerate(batch.column("text")):
                ids = encoder.ids(text.as_py())
                for k, (start, length) in enumerate(cut_up(len(ids), capacity)):
                    part = ids[start : start + length]
                    own.append(d)
                    rows.append((k, start, length, zlib.crc32(part.astype("<u4").tobytes()), *[part.astype(np.int32)] * with_ids))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True)] if rows else [pa.array([], t) for t in types[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own, pa.int64())), *cols], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, n_groups: int = GROUPS) -> DataFrame:
    """The pieces with sequence_id and offset."""
    prepare(docs.sparkSession)
    cutted = cut(pieces(docs, capacity, with_ids)).withColumn("_part", F.spark_partition_id())
    counts = cut(cutted.groupBy("_part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = lookup(plan(histogram, capacity, n_groups))
    if len(table["key"]) > MAX_PLAN:
        raise RuntimeError(f"a plan of {len(table['key'])} rows for capacity {capacity}")
    runs = cutted.sparkSession.sparkContext.broadcast(table)
    # Rank among the pieces of a length: those of earlier partitions, then those before it in its own. The
    # partitions are files by now, so neither number changes if a task runs again.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_part", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cutted.withColumn("_own", own).join(counts.select("_part", "length", before.alias("_before")), ["_part", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    rows = ranked.select(*names, (F.col("_before") + F.col("_own")).alias("_rank"))
    schema = rows.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        t = runs.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(t["key"], (length << 48) | rank, side="right") - 1
            cols = [pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], names=schema.names)

    return rows.mapInArrow(place, schema)
