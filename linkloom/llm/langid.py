"""Language identification by interpolated Kneser-Ney character models.

One model per language holds two sorted hash arrays: n-grams with their interpolated
log-probability, and contexts with the log of their back-off weight. A text gets, per
language, its cross-entropy per character; the lowest wins. A text whose cross-entropy
lies too far above what held-out texts of the winner show is marked as rejected.

Defined results: null text or text without a letter gives ``und``, score 0, rejected;
rows with a null doc_id are learned from like others, null lang from none;
repeated rows are scored alike; no rows give no rows; with nothing to learn from, every
text gives ``und``. Other columns of the input never matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut, join_hot, prepare, spool

ORDER = 5
PAD = ORDER - 1
UNDETERMINED = "und"
ALPHABET = 2048  # characters over which the last back-off is uniform; more, if a language has more
MIX = np.uint64(0x9E3779B97F4A7C15)
HASHES = 1 << 40
STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class TrainingBounds:
    """What the fit may read: a sample of whole labelled texts, and the size of each model."""

    docs_per_lang: int = 400  # texts of any length
    max_ngrams: int = 600_000  # stored per language and order; the rarest are left to their back-off
    group_bytes: int = 96_000_000  # of models that a task holds at once, or one model, if that is larger


@dataclass
class Model:
    lang: str
    gram_keys: np.ndarray
    gram_logp: np.ndarray
    ctx_keys: np.ndarray
    ctx_logb: np.ndarray
    mean: float
    between: float
    within: float
    z: float = 0.0  # calibrated limit of a text's distance from the mean
    alphabet: int = ALPHABET


_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with single blanks between words, each text after PAD blanks; and where each text starts."""
    is_letter = _letters()
    parts, starts, at = [], [], 0
    for text in texts:
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        keep = is_letter[cp]
        prev = np.empty_like(keep)
        prev[:1] = False
        prev[1:] = keep[:-1]
        body = np.where(keep, cp, 32)[keep | prev]
        starts.append(at)
        parts.append(np.full(PAD, 32, dtype=np.uint32))
        parts.append(body.astype(np.uint32))
        at += PAD + len(body)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array(starts, dtype=np.int64)


def gram_hashes(cp: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each position (positions before n - 1 hold no n-gram)."""
    h = np.full(len(cp), n, dtype=np.uint64)
    for back in range(n - 1, -1, -1):
        shifted = np.zeros(len(cp), dtype=np.uint64)
        shifted[back:] = cp[: len(cp) - back]
        h = (h ^ (shifted + MIX)) * STEP
        h ^= h >> np.uint64(29)
    return h


def _scored(n_chars: int, starts: np.ndarray) -> np.ndarray:
    """Which positions hold a character of a text, not padding."""
    mask = np.ones(n_chars, dtype=bool)
    for k in range(PAD):
        mask[starts + k] = False
    return mask


def _discount(counts: np.ndarray) -> float:
    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


FIT_CHARS = 1_000_000  # counted at a time


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of ORDER characters (rows of code points) and how often each occurs."""
    windows, counts = np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    for run in _runs(texts, FIT_CHARS):
        cp, starts = code_points(run)
        ends = np.flatnonzero(_scored(len(cp), starts))
        _, first, count = np.unique(gram_hashes(cp, ORDER)[ends], return_index=True, return_counts=True)
        windows = np.concatenate([windows, cp[ends[first][:, None] + np.arange(-PAD, 1)].astype(np.uint32)])
        counts = np.concatenate([counts, count])
        _, first, group = np.unique(_window_hashes(windows, ORDER), return_index=True, return_inverse=True)
        windows, counts = windows[first], np.bincount(group, weights=counts, minlength=len(first)).astype(np.int64)
    return windows, counts


def _window_hashes(windows: np.ndarray, n: int) -> np.ndarray:
    """Hash of the last n characters of each window."""
    if not len(windows):
        return np.zeros(0, np.uint64)
    return gram_hashes(windows.reshape(-1), n)[ORDER - 1 :: ORDER]


def estimate(lang: str, texts: list[str], max_ngrams: int) -> Model:
    """Interpolated Kneser-Ney: raw counts at the top order, numbers of left continuations below.

    Discounts and totals come of all counts. Of an order with more than max_ngrams the rarest aren't stored: what
    they had above their back-off goes to the context's back-off weight, so that its probabilities still add up to 1.
    """
    types = {ORDER: windows_of(texts)}
    for n in range(ORDER - 1, 0, -1):
        above = types[n + 1][0]
        _, first, count = np.unique(_window_hashes(above, n), return_index=True, return_counts=True)
        types[n] = (above[first], count)
    alphabet = max(ALPHABET, len(types[1][0]) + 1)  # whatever it hasn't seen is one character at least
    grams, logps, ctxs, logbs = [], [], [], []
    lower_keys, lower_p = np.zeros(0, np.uint64), np.zeros(0)
    for n in range(1, ORDER + 1):
        windows, count = types[n]
        d = _discount(count)
        keys = _window_hashes(windows, n)
        # The context is the n - 1 characters before the last one.
        shifted = np.concatenate([np.zeros((len(windows), 1), np.uint32), windows[:, :-1]], axis=1)
        ctx = _window_hashes(shifted, n - 1) if n > 1 else np.zeros(len(windows), np.uint64)
        ctx_key, inverse = np.unique(ctx, return_inverse=True)
        total = np.bincount(inverse, weights=count, minlength=len(ctx_key))
        kept = np.ones(len(count), bool)
        if len(count) > max_ngrams:
            kept[np.argsort(-count, kind="stable")[max_ngrams:]] = False
        own = np.where(kept, (count - d) / total[inverse], 0.0)
        back = 1.0 - np.bincount(inverse, weights=own, minlength=len(ctx_key))
        below = np.full(len(count), 1.0 / alphabet) if n == 1 else lower_p[np.searchsorted(lower_keys, _window_hashes(windows, n - 1))]
        p = own + back[inverse] * below
        order = np.argsort(keys)
        lower_keys, lower_p = keys[order], p[order]
        grams.append(keys[kept])
        logps.append(np.log2(p[kept]))
        used = np.bincount(inverse[kept], minlength=len(ctx_key)) > 0  # others back off whole
        ctxs.append(ctx_key[used])
        logbs.append(np.log2(back[used]))
    gram_keys, ctx_keys = np.concatenate(grams), np.concatenate(ctxs)
    g, c = np.argsort(gram_keys), np.argsort(ctx_keys)
    return Model(lang, gram_keys[g], np.concatenate(logps)[g].astype(np.float32), ctx_keys[c], np.concatenate(logbs)[c].astype(np.float32), 0.0, 0.0, 0.0, 0.0, alphabet)


def fit(lang: str, texts: list[str], max_ngrams: int) -> Model:
    """A model of the texts that calibrates its rejection on texts it wasn't fitted to.

    Of ten texts or more a fifth is held out. Of fewer, each half in turn is scored by a model of the other half,
    and the model is that of all. A language with a single text rejects nothing.
    """
    if len(texts) >= 10:
        train, parts = [t for i, t in enumerate(texts) if i % 5], [texts[::5]]
        model = estimate(lang, train, max_ngrams)
        scorers = [Scorer([model])]
    else:
        parts = [texts[::2], texts[1::2]]
        model = estimate(lang, texts, max_ngrams)
        scorers = [Scorer([estimate(lang, part, max_ngrams)]) for part in reversed(parts)] if len(texts) > 1 else []
    per_text, sizes, spread = [], [], []
    for scorer, part in zip(scorers, parts, strict=False):
        for text in part:
            logp = scorer.per_char([text])
            if len(logp):
                per_text.append(-float(logp.mean()))
                sizes.append(len(logp))
                spread.append(float(logp.var()))
    model.mean = float("inf")
    if per_text:
        h, w = np.array(per_text), np.array(sizes, dtype=float)
        model.mean = float(np.average(h, weights=w))
        model.within = float(np.average(spread, weights=w))
        model.between = float(max(0.01, np.average((h - model.mean) ** 2, weights=w)))
        model.z = float(((h - model.mean) / np.sqrt(model.between + model.within / w)).max())
    return model


class Scorer:
    """Log-probabilities by binary search in the sorted arrays, each distinct 5-gram looked up once."""

    def __init__(self, models: Iterable[Model], cache_size: int = 250_000):
        self.models = models = list(models)
        self.cache_size = cache_size
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros((0, len(models)), np.float32)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return at, keys[at] == wanted

    def _look_up(self, windows: np.ndarray) -> np.ndarray:
        """Log2 probability of the last character of each window (rows of ORDER code points), per model."""
        flat = windows.reshape(-1)
        ends = np.arange(len(windows)) * ORDER + ORDER - 1
        gram = {n: gram_hashes(flat, n)[ends] for n in range(1, ORDER + 1)}
        ctx = {n: (gram_hashes(flat, n - 1)[ends - 1] if n > 1 else np.zeros(len(windows), np.uint64)) for n in range(1, ORDER + 1)}
        out = np.zeros((len(windows), len(self.models)), np.float32)
        for m, model in enumerate(self.models):
            total = np.zeros(len(windows), np.float32)
            todo = np.arange(len(windows))
            for n in range(ORDER, 0, -1):
                at, hit = self._find(model.gram_keys, gram[n][todo])
                total[todo[hit]] += model.gram_logp[at[hit]]
                todo = todo[~hit]
                if not len(todo):
                    break
                at, hit = self._find(model.ctx_keys, ctx[n][todo])
                total[todo[hit]] += model.ctx_logb[at[hit]]
            total[todo] -= np.log2(model.alphabet)
            out[:, m] = total
        return out

    def _rows(self, cp: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position, its row in the returned table of values."""
        keys, first, inverse = np.unique(gram_hashes(cp, ORDER)[positions], return_index=True, return_inverse=True)
        at, hit = self._find(self.keys, keys)
        values = np.empty((len(keys), len(self.models)), np.float32)
        values[hit] = self.values[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            ends = positions[first[new]]
            values[new] = self._look_up(cp[ends[:, None] + np.arange(-PAD, 1)])
            if len(self.keys) + len(new) > self.cache_size:
                self.keys, self.values = keys, values
            else:
                merged = np.concatenate([self.keys, keys[new]])
                order = np.argsort(merged, kind="stable")
                self.keys, self.values = merged[order], np.concatenate([self.values, values[new]])[order]
        return values, inverse

    def per_char(self, texts: list[str]) -> np.ndarray:
        """Log2 probabilities of all characters under the first model."""
        cp, starts = code_points(texts)
        positions = np.flatnonzero(_scored(len(cp), starts))
        if not len(positions):
            return np.zeros(0)
        values, row = self._rows(cp, positions)
        return values[row, 0]

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and model the summed log2 probability, and the number of characters scored."""
        cp, starts = code_points(texts)
        ends = np.append(starts[1:], len(cp))
        sizes = ends - starts - PAD
        sums = np.zeros((len(texts), len(self.models)))
        positions = np.flatnonzero(_scored(len(cp), starts))
        if len(positions):
            values, row = self._rows(cp, positions)
            begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            full = np.flatnonzero(sizes)
            for m in range(len(self.models)):
                sums[full, m] = np.add.reduceat(values[row, m].astype(np.float64), begin[full])
        return sums, sizes


def judge(scorer: Scorer, texts: list[str], z: float) -> list[tuple[str, float, bool, float]]:
    """(language, score, rejected, cross-entropy) of each text.

    score is the winner's share of 2 ** (-H * 12) over the languages: twelve characters' worth of evidence. The limit
    of the rejection is z standard deviations, or what a quarter more than the farthest held-out text needs.
    """
    sums, sizes = scorer.totals(texts)
    out = []
    for total, n in zip(sums, sizes, strict=True):
        if not n or not scorer.models:
            out.append((UNDETERMINED, 0.0, True, 0.0))
            continue
        h = -total / n
        best = int(np.argmin(h))
        model = scorer.models[best]
        share = 1.0 / float(np.exp2(-12.0 * (h - h[best])).sum())
        limit = model.mean + max(z, 1.25 * model.z) * float(np.sqrt(model.between + model.within / n))
        out.append((model.lang, share, bool(h[best] > limit), float(h[best])))
    return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Models:
    """A written table of models, one row for each language, in groups of a bounded size. Iterating loads group after group."""

    FIELDS = ("gk", "gp", "ck", "cb")

    def __init__(self, rows: DataFrame, group_bytes: int):
        size = sum((F.length(f) for f in self.FIELDS), F.lit(0)).cast("long")
        before = F.coalesce(F.sum("size").over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes = rows.where(F.length("gk") > 0).select("lang", size.alias("size"))  # as many narrow rows as there are labels
        self.dealt = cut(sizes.select("lang", F.floor(before / group_bytes).alias("group")))
        self.rows = rows
        self.groups = [r["group"] for r in self.dealt.select("group").distinct().orderBy("group").collect()]

    def load(self, group: int) -> list[Model]:
        found = self.rows.join(self.dealt.where(F.col("group") == group).select("lang"), "lang").collect()
        arrays = lambda r: (np.frombuffer(r[f], t) for f, t in zip(self.FIELDS, (np.uint64, np.float32, np.uint64, np.float32), strict=True))
        return sorted((Model(r["lang"], *arrays(r), r["mean"], r["between"], r["within"], r["z"], r["alphabet"]) for r in found), key=lambda m: m.lang)

    def __iter__(self) -> Iterator[Model]:
        for group in self.groups:
            yield from self.load(group)


def train(docs: DataFrame, bounds: TrainingBounds = TrainingBounds()) -> Models:
    """Models of all languages in ``docs`` (doc_id, text, lang), each fitted in one task on its bounded sample.

    The sample: per language the docs_per_lang rows with the smallest hash of doc_id and text, repeated rows once.
    Hashes are chosen first, among those below a limit that follows from the language's number of different rows, so that
    a task ranks few at any corpus size; the texts of the chosen are then picked in another scan. There may be any
    number of labels: nothing but a model's own size is bounded.
    """
    prepare(docs.sparkSession)
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(HASHES))
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", mark.alias("mark"))
    counts = cut(usable.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("mark").alias("n")))
    # Hashes below a limit are four times what is wanted; of these the smallest are taken. A language with few texts has no limit.
    limit = F.least(F.lit(HASHES), F.floor(F.lit(4 * bounds.docs_per_lang * HASHES) / F.greatest(F.col("n"), F.lit(1))))
    limits = counts.select("lang", "rows", limit.alias("below"))
    few = join_hot(usable.select("lang", "mark"), limits, ["lang"], "rows").where(F.col("mark") < F.col("below")).select("lang", "mark").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    chosen = spool(few.withColumn("r", rank).where(F.col("r") <= bounds.docs_per_lang).select("lang", "mark"), "language-sample")
    # Written, so that Spark knows its size and sends it to the rows or not. Repeated rows fold before the shuffle.
    sample = usable.join(chosen, ["lang", "mark"], "left_semi").groupBy("lang", "mark").agg(F.min("text").alias("text"))

    def fit_one(key, frame):
        import pandas as pd

        m = fit(key[0], list(frame.sort_values("mark")["text"]), bounds.max_ngrams)
        row = [m.lang, m.gram_keys.tobytes(), m.gram_logp.tobytes(), m.ctx_keys.tobytes(), m.ctx_logb.tobytes(), m.mean, m.between, m.within, m.z, m.alphabet]
        return pd.DataFrame([row], columns=["lang", *Models.FIELDS, "mean", "between", "within", "z", "alphabet"])

    schema = "lang string, gk binary, gp binary, ck binary, cb binary, mean double, between double, within double, z double, alphabet long"
    return Models(spool(sample.groupBy("lang").applyInPandas(fit_one, schema), "language-models"), bounds.group_bytes)


CHUNK_CHARS = 400_000


def _runs(texts, chars: int) -> Iterator[list[str]]:
    """Runs of the texts of about so many characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def _judged(docs: DataFrame, models: list[Model], keep: list[str], z: float):
    """docs judged by models that fit in a task, and their broadcast."""
    packed = docs.sparkSession.sparkContext.broadcast(models)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean").add("cross_entropy", "double")

    def run(batches):
        scorer = Scorer(packed.value)
        for batch in batches:
            found: list = []
            for part in _runs((t.as_py() or "" for t in batch.column("text")), CHUNK_CHARS):
                found += judge(scorer, part, z)
            cols = [batch.column(name) for name in keep] + [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "rejected", "cross_entropy"])

    need = keep if "text" in keep else [*keep, "text"]
    return docs.select(*need).mapInArrow(run, schema), packed


def identify(docs: DataFrame, models: Models | list[Model], keep: list[str], z: float = 8.0) -> DataFrame:
    """The columns ``keep`` of docs, then lang_pred, score, rejected, cross_entropy.

    One group of models is sent to the tasks. Where there are more, each group in turn judges all texts, and the best of
    its winners is a text's language; its share then counts the languages of all groups.
    """
    prepare(docs.sparkSession)
    groups = [None] if isinstance(models, list) else models.groups
    load = lambda group: models if isinstance(models, list) else models.load(group)
    if len(groups) <= 1:
        return _judged(docs, load(groups[0]) if groups else [], keep, z)[0]
    rows = spool(docs.select(F.struct(*keep).alias("kept"), F.col("text").alias("text")).withColumn("row", F.monotonically_increasing_id()), "language-rows")
    parts = []
    for group in groups:
        part, packed = _judged(rows, load(group), ["row"], z)
        parts.append(spool(part, "language-part"))
        packed.destroy()
    every = F.collect_list(F.struct("cross_entropy", "lang_pred", "score", "rejected"))  # one for each group
    best = reduce(DataFrame.unionByName, parts).groupBy("row").agg(every.alias("every")).withColumn("best", F.array_min("every"))
    shares = F.aggregate("every", F.lit(0.0), lambda total, g: total + F.pow(F.lit(2.0), -12.0 * (g["cross_entropy"] - F.col("best.cross_entropy"))) / g["score"])
    score = F.when(F.col("best.score") > 0, 1.0 / shares).otherwise(0.0).alias("score")
    return rows.join(best, "row").select("kept.*", "best.lang_pred", score, "best.rejected", "best.cross_entropy")
