"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts: how often each byte, or the end of a text, followed each context of up to five
bytes in the texts it learns from, all of them. A byte's probability is its share among what followed its longest
known context; the number of different followers stands for the escape (method C). What a longer context has already
ruled out is excluded in the shorter ones; below no context at all, the symbols never seen share what is left.

The trie is a table. A task takes a block of documents and gives the block's distinct six-symbol windows and words, with
how often its learning documents have them. Counts are added up over all blocks. A window's probability follows from the
counts that share its middle: windows are dealt by the three symbols before their last, at most 17 million for each of these,
and meet the counts of the shorter contexts, of which the alphabet bounds the number. Probabilities go back to the blocks
that asked for them, where each document's are summed. No text leaves its block.

Defined results: a null text is empty; an empty text is its end alone; a null doc_id is learned from like others; repeated
rows count as often as they occur and score alike; with nothing to learn from every symbol has one chance in 257 and every
token's base is 1 / 1; no rows give no rows; other columns never matter, whatever their names. Texts of any length are
scored whole. Words of more than 64 bytes are looked up by their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from linkloom.llm.common import join_hot, prepare, spool

ORDER = 5
BITS = 9  # a symbol: 0 before a text, a byte plus one, the end
END = 257
SYMBOLS = 257  # what can follow a context
SHARED = 3  # windows with the same so many symbols before their last are solved in one task
RUN_CHARS, RUN_DOCS, BLOCK_CHARS = 500_000, 1 << 10, 32_000_000
MOST_CODES, PIECE = 6_000_000, 500_000  # distinct windows at which a block ends; windows in a row that is written
GROUP_CODES = 500_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LONGEST = 64
DOC_BITS = 10  # six symbols leave so many bits of a long for the number of a document in its run


def last(codes, n: int):
    """The last n symbols of windows; of NumPy arrays or Spark columns alike."""
    mask = (1 << BITS * n) - 1
    return codes & mask if isinstance(codes, np.ndarray) else codes.bitwiseAND(F.lit(mask).cast("long"))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The window of ORDER symbols and the next one at each byte and at the end of each text; and how many each text has."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    flat = np.zeros(int(sizes.sum()) + ORDER * len(texts), np.int64)
    ends = np.cumsum(sizes + ORDER)
    flat[ends - 1] = END
    inside = np.ones(len(flat), bool)
    for k in range(ORDER):
        inside[ends - sizes - 1 - k] = False
    body = inside.copy()
    body[ends - 1] = False
    flat[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    codes = flat.copy()
    for k in range(1, ORDER + 1):
        codes[k:] |= flat[:-k] << (BITS * k)
    return codes[inside], sizes


def words_of(text: bytes) -> list[bytes]:
    found = text.split()  # at the six characters that end a word
    if len(text) > LONGEST and max(map(len, found), default=0) > LONGEST:
        found = [w if len(w) <= LONGEST else b" " + hashlib.sha256(w).digest() for w in found]
    return found


def _first_of_runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin, of sorted keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


class Tally:
    """Distinct windows with counts, from many runs."""

    def __init__(self):
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: list = []
        self.waiting = 0

    def add(self, codes: np.ndarray, times: int) -> None:
        """Windows that count so many times each: once, or not at all."""
        keys, counts = np.unique(codes, return_counts=True)
        self.parts.append((keys, counts * times))
        self.waiting += len(keys)
        if self.waiting > max(1_000_000, len(self.codes)):
            self.merge()

    def merge(self) -> None:
        parts = [(self.codes, self.counts), *self.parts]
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")  # which merges what is sorted already
        keys = keys[order]
        first = _first_of_runs(keys)
        counts = np.concatenate([c for _, c in parts])[order]
        self.codes, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.parts, self.waiting = [], 0


def blocks(docs: DataFrame, learned) -> DataFrame:
    """Two kinds of rows, written once. With run >= 0: a document, and with the first of a run the texts of all of it.
    With run = -1: a piece of a block's distinct windows or words and their counts in its learning documents."""
    prepare(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("learned", "boolean").add("block", "long").add("run", "integer").add("pos", "integer").add("n_tokens", "long").add("texts", "binary")
    schema = schema.add("codes", "binary").add("counts", "binary").add("words", ArrayType(BinaryType())).add("word_counts", ArrayType(LongType()))
    kinds = [None, pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    class Block:
        def __init__(self, number: int):
            self.number, self.tally, self.words, self.others, self.size, self.runs = number, Tally(), Counter(), set(), 0, 0

        def run(self, ids: list, texts: list[bytes], learn: list[bool]) -> pa.RecordBatch:
            codes, sizes = windows(texts)
            learned = np.repeat(np.array(learn, bool), sizes)
            self.tally.add(codes[learned], 1)
            self.tally.add(codes[~learned], 0)
            n_tokens = []
            for text, own in zip(texts, learn, strict=True):
                found = [*words_of(text), b""]
                n_tokens.append(len(found))
                (self.words if own else self.others).update(found)
            packed = zstandard.ZstdCompressor(level=3).compress(b"\xff".join(texts))  # no byte of UTF-8 is 0xFF
            n, kind = len(texts), ids[0].type
            columns = [
                pa.concat_arrays(ids), pa.array(learn), pa.array([self.number] * n), pa.array([self.runs] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(n_tokens),
                pa.array([packed, *[None] * (n - 1)], pa.binary()), *(pa.nulls(n, k) for k in kinds[7:]),
            ]
            self.runs += 1
            self.size += sum(map(len, texts))
            self.kind = kind
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def pieces(self):
            self.tally.merge()
            codes, counts = self.tally.codes, self.tally.counts
            words = sorted(({**self.words, **dict.fromkeys(self.others - self.words.keys(), 0)}).items())
            for at in range(0, max(len(codes), len(words)), PIECE):
                own = words[at : at + PIECE]
                c = codes[at : at + PIECE]
                values = [None, None, self.number, -1, None, None, None, np.diff(c, prepend=0).tobytes(), counts[at : at + PIECE].astype(np.uint32 if len(counts) and counts.max() < 2**32 else np.int64).tobytes(), [w for w, _ in own], [n for _, n in own]]
                yield pa.RecordBatch.from_arrays([pa.array([v], k or self.kind) for v, k in zip(values, kinds, strict=True)], names=schema.names)

    def run(batches):
        block = Block(TaskContext.get().partitionId() << 32)
        ids, texts, learn, size = [], [], [], 0
        for batch in batches:
            begin = 0
            for k, (text, own) in enumerate(zip(batch.column("text"), batch.column("learned"), strict=True)):
                texts.append((text.as_py() or "").encode().translate(LOWER))
                learn.append(own.as_py())
                size += len(texts[-1])
                if size >= RUN_CHARS or len(texts) == RUN_DOCS:
                    yield block.run([*ids, batch.column("doc_id").slice(begin, k + 1 - begin)], texts, learn)
                    ids, texts, learn, size, begin = [], [], [], 0, k + 1
                    if block.size >= BLOCK_CHARS or len(block.tally.codes) >= MOST_CODES:
                        yield from block.pieces()
                        block = Block(block.number + 1)
            ids.append(batch.column("doc_id").slice(begin))
        if texts:
            yield block.run(ids, texts, learn)
        if block.runs:
            yield from block.pieces()

    rows = docs.select("doc_id", "text", learned.alias("learned"))
    return spool(rows.mapInArrow(run, schema), "ppm-blocks", "zstd")


def asked(written: DataFrame) -> DataFrame:
    """block, code, n: the distinct windows of each block, with their counts in its learning documents."""

    def run(batches):
        for batch in batches:
            for block, codes, counts in zip(*(batch.column(c) for c in ("block", "codes", "counts")), strict=True):
                own = np.cumsum(np.frombuffer(codes.as_py(), np.int64))
                packed = counts.as_py()
                n = np.frombuffer(packed, np.uint32 if len(packed) < 8 * len(own) else np.int64).astype(np.int64)
                for at in range(0, len(own), 50_000):
                    part = own[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block.as_py())), pa.array(part), pa.array(n[at : at + 50_000])], names=["block", "code", "n"])

    return written.where("run = -1").select("block", "codes", "counts").mapInArrow(run, "block long, code long, n long")


def asked_words(written: DataFrame) -> DataFrame:
    """block, word, n: likewise the words; the end of a text is the empty word."""
    both = F.explode(F.arrays_zip("words", "word_counts")).alias("w")
    return written.where("run = -1").select("block", both).select("block", F.col("w.words").alias("word"), F.col("w.word_counts").alias("n"))


def shorter(codes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of n symbols with their counts, from longer ones."""
    keys, place = np.unique(last(codes, n), return_inverse=True)
    return keys, np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def solve(wanted: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log10 probability of the last symbol of each window.

    levels[j]: sorted windows of j + 1 symbols with their counts, for every context of j symbols that wanted has.
    """
    out, todo = np.zeros(len(wanted)), np.arange(len(wanted))
    after = np.full(len(wanted), -1)  # the place of the next longer context among those known, or -1
    above = None  # of the next longer contexts: what is left of their shorter one without what followed them
    contexts: list = []
    for grams, counts in levels:
        known, place = np.unique(grams >> BITS, return_inverse=True)
        contexts.append((known, place, np.bincount(place, weights=counts, minlength=len(known)), np.bincount(place, minlength=len(known)).astype(float)))
    for j in range(len(levels) - 1, -1, -1):
        if not len(todo):
            return out
        (grams, counts), (known, place, total, kinds) = levels[j], contexts[j]
        own = last(wanted[todo], j + 1)
        context, seen = _find(known, own >> BITS)
        t, q = (np.where(seen, x[context], 0.0) if len(known) else np.zeros(len(todo)) for x in (total, kinds))
        if above is not None:
            narrowed = after[todo] >= 0
            t, q = (np.where(narrowed, x[np.maximum(after[todo], 0)] if len(x) else y, y) for x, y in zip(above, (t, q), strict=True))
        at, hit = _find(grams, own)
        out[todo[hit]] += np.log10(counts[at[hit]] / (t[hit] + q[hit]))
        escapes = ~hit & (q > 0)
        out[todo[escapes]] += np.log10(q[escapes] / (t[escapes] + q[escapes]))
        after[todo] = np.where(seen, context, -1)
        if j:
            (low, n_low), (low_known, _, low_total, low_kinds) = levels[j - 1], contexts[j - 1]
            gone = np.bincount(place, weights=n_low[_find(low, last(grams, j))[0]] if len(low) else None, minlength=len(known))
            under = _find(low_known, last(known, j - 1))[0]
            above = (low_total[under] - gone, low_kinds[under] - kinds) if len(known) else (np.zeros(0), np.zeros(0))
        todo = todo[~hit]
    out[todo] -= np.log10(SYMBOLS - len(levels[0][0]))
    return out


def probabilities(counts: DataFrame) -> DataFrame:
    """code, logp of every window of counts (code, n)."""
    spark = counts.sparkSession
    seen = counts.where("n > 0")
    three = spool(seen.groupBy(last(F.col("code"), 3).alias("gram")).agg(F.sum("n").alias("n")), "ppm-three")  # at most 257^3 rows
    pairs = three.groupBy(last(F.col("gram"), 2).alias("gram")).agg(F.sum("n").alias("n")).collect()  # at most 258 * 257 rows
    two = sorted((r["gram"], r["n"]) for r in pairs)
    two = (np.array([g for g, _ in two], np.int64), np.array([n for _, n in two], np.int64))
    low = spark.sparkContext.broadcast([shorter(*two, 1), two])
    groups = max(1, -(-counts.count() // GROUP_CODES))
    middle = last(F.shiftright("code", BITS), SHARED)
    dealt = counts.select(F.pmod(F.xxhash64(middle), F.lit(groups)).cast("int").alias("deal"), "code", "n")
    needs = dealt.select("deal", last(F.shiftright("code", BITS), 2).alias("context")).distinct()
    shared = needs.join(three.select(F.shiftright("gram", BITS).alias("context"), "gram", "n"), "context").select(F.col("deal").alias("to"), "gram", "n")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        code, n = left.column("code").to_numpy(), left.column("n").to_numpy()
        order = np.argsort(code)
        code, n = code[order], n[order]
        grams, held = right.column("gram").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(grams)
        own = [(code[n > 0], n[n > 0])]
        for size in range(ORDER, SHARED, -1):
            own.append(shorter(*own[-1], size))
        return pa.table({"code": code, "logp": solve(code, [*low.value, (grams[order], held[order]), *own[::-1]])})

    return dealt.groupBy("deal").cogroup(shared.groupBy("to")).applyInArrow(answer, "code long, logp double")


def score(docs: DataFrame, learned) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score of every document.

    learned: a boolean column of docs, true where the models learn from the document.
    """
    written = blocks(docs, learned)
    windows_asked, words_asked = asked(written), asked_words(written)
    counts = spool(windows_asked.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")), "ppm-windows", "zstd")
    words = spool(words_asked.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")), "ppm-words", "zstd")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_train, least = int(total["n"]), float(int(total["n"]) + int(total["v"]) + 1)
    logp = probabilities(counts.select("code", "n")).join(counts.select("code", "blocks"), "code")
    found = join_hot(windows_asked.select("block", "code"), spool(logp, "ppm-logp", "zstd"), ["code"], "blocks").select("block", "code", F.lit(None).cast("binary").alias("word"), F.col("logp").alias("value"))
    heard = join_hot(words_asked.select("block", "word"), words, ["word"], "blocks").select("block", F.lit(None).cast("long").alias("code"), "word", F.col("n").cast("double").alias("value"))
    out = ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = written.select("doc_id", "learned").schema
    for name in out[2:]:
        schema = schema.add(name, "double" if name.endswith("score") else "long")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = right.column("code").is_null().to_numpy()
        codes, logs = right.column("code").filter(pa.array(~is_word)).to_numpy(), right.column("value").filter(pa.array(~is_word)).to_numpy()
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order]
        own = right.filter(pa.array(is_word))
        del right
        words_here, times = own.column("word").to_pylist(), own.column("value").to_numpy()
        unknown = {words_here[i] for i in np.flatnonzero(times == 0).tolist()}
        base = dict(zip(words_here, np.log10((times + 1) / least).tolist(), strict=True))
        del own, words_here
        left = left.sort_by([("run", "ascending"), ("pos", "ascending")])
        known, bases, scores = [], [], []
        for packed in left.column("texts"):
            if not packed.is_valid:
                continue
            texts = zstandard.ZstdDecompressor().decompress(packed.as_py()).split(b"\xff")
            here, sizes = windows(texts)
            # Sorted with their documents' numbers in the low bits, so that each distinct window is looked up once.
            here = np.sort(here.astype(np.uint64) << np.uint64(DOC_BITS) | np.repeat(np.arange(len(texts), dtype=np.uint64), sizes))
            whose = (here & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
            here = (here >> np.uint64(DOC_BITS)).astype(np.int64)
            first = _first_of_runs(here)
            value = np.repeat(logs[np.searchsorted(codes, here[first])], np.diff(np.append(first, len(here))))
            scores += np.bincount(whose, weights=value, minlength=len(texts)).tolist()
            for text in texts:
                found_words = [*words_of(text), b""]
                known.append(len(found_words) - (sum(map(unknown.__contains__, found_words)) if unknown else 0))
                bases.append(sum(map(base.__getitem__, found_words)))
        given = {"n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([n_train] * len(known), pa.int64()), "base_score": pa.array(bases, pa.float64()), "score": pa.array(scores, pa.float64())}
        return pa.table({name: given[name] if name in given else left.column(name) for name in out})

    rows = written.where("run >= 0").select("block", "run", "pos", "doc_id", "learned", "n_tokens", "texts")
    return rows.groupBy("block").cogroup(found.unionByName(heard).groupBy("block")).applyInArrow(sums, schema)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def oracle() -> str:
    """DuckDB SQL for the query: counts of windows of every length, then each distinct window's way down the contexts."""
    crc = "list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))"
    mask = lambda n: (1 << BITS * n) - 1
    top = ORDER
    symbols = " | ".join(f"(coalesce(lag(s, {k}) OVER w, 0) << {BITS * k})" for k in range(1, top + 1))
    tables = [f"g{top} AS MATERIALIZED (SELECT code AS g, count(*) AS n FROM windows WHERE NOT held GROUP BY 1)"]
    tables += [f"g{j} AS MATERIALIZED (SELECT g & {mask(j + 1)} AS g, CAST(sum(n) AS BIGINT) AS n FROM g{j + 1} GROUP BY 1)" for j in range(top - 1, -1, -1)]
    tables += [f"c{j} AS MATERIALIZED (SELECT g >> {BITS} AS c, CAST(sum(n) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS q FROM g{j} GROUP BY 1)" for j in range(top + 1)]
    for j in range(1, top + 1):
        gone = f"SELECT a.g >> {BITS} AS c, sum(b.n) AS gone FROM g{j} a JOIN g{j - 1} b ON b.g = a.g & {mask(j)} GROUP BY 1"
        tables.append(f"x{j} AS MATERIALIZED (SELECT o.c, u.t - e.gone AS t, u.q - o.q AS q FROM c{j} o JOIN ({gone}) e USING (c) JOIN c{j - 1} u ON u.c = o.c & {mask(j - 1)})")
    joins, columns = [], []
    for j in range(top, -1, -1):
        joins.append(f"LEFT JOIN g{j} ON g{j}.g = d.code & {mask(j + 1)} LEFT JOIN c{j} ON c{j}.c = (d.code >> {BITS}) & {mask(j)}")
        if j:
            joins.append(f"LEFT JOIN x{j} ON x{j}.c = (d.code >> {BITS}) & {mask(j)}")
        t, q = ((f"coalesce(x{j + 1}.{v}, c{j}.{v}, 0)" for v in "tq") if j < top else (f"coalesce(c{j}.{v}, 0)" for v in "tq"))
        columns += [f"g{j}.n AS n{j}", f"{t} AS t{j}", f"{q} AS q{j}"]
    way = f"-log10({SYMBOLS} - (SELECT count(*) FROM g0))"
    for j in range(top + 1):
        way = f"CASE WHEN n{j} IS NOT NULL THEN log10(n{j} / (t{j} + q{j})) ELSE CASE WHEN q{j} > 0 THEN log10(q{j} / (t{j} + q{j})) ELSE 0 END + {way} END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    nl = ",\n"
    return f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
marked AS MATERIALIZED (SELECT r, doc_id, text, doc_id IS NOT NULL AND xor({crc}, 4294967295) % 7 = 2 AS held FROM docs),
signs AS (SELECT r, held, list_concat(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT) + 1), [CAST({END} AS BIGINT)]) AS own FROM marked),
placed AS (SELECT r, held, unnest(own) AS s, unnest(range(len(own))) AS p FROM signs),
windows AS MATERIALIZED (SELECT r, held, s | {symbols} AS code FROM placed WINDOW w AS (PARTITION BY r ORDER BY p)),
{nl.join(tables)},
looked AS (SELECT d.code, {', '.join(columns)} FROM (SELECT DISTINCT code FROM windows) d {' '.join(joins)}),
logs AS MATERIALIZED (SELECT code, {way} AS lp FROM looked),
scores AS (SELECT r, sum(lp) AS score FROM windows JOIN logs USING (code) GROUP BY r),
tokens AS MATERIALIZED (SELECT r, held, unnest(list_concat(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), [''])) AS w FROM marked),
seen AS MATERIALIZED (SELECT w, count(*) AS c FROM tokens WHERE NOT held GROUP BY w),
total AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM seen),
bases AS (
  SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))) AS base_score
  FROM tokens LEFT JOIN seen USING (w), total GROUP BY r)
SELECT doc_id, held AS held_out, n_tokens, n_known, n AS train_tokens, base_score, score FROM marked JOIN scores USING (r) JOIN bases USING (r), total"""
