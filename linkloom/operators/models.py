"""Pair models: boosted stumps and logistic regression with native scoring, and the two-stage tree model.

Stumps are fitted on a bounded sample that comes to the driver (``MAX_SAMPLE`` rows of the smallest hash), the other
models on all rows; scoring by stumps and by the logistic model is a Column expression.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import url as url_functions
from linkloom.operators.sampling import mark

MAX_SAMPLE = 200_000


class Matcher(Protocol):
    """What scores pairs: a table of pairs with features in, the same with ``score`` out."""

    def score(self, pairs: DataFrame) -> DataFrame: ...


def bounded_sample(df: DataFrame, features: list[str], label: str, ids: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = df.orderBy(mark(42, *ids)).limit(MAX_SAMPLE).select(*features, label).toPandas()
    return rows[features].to_numpy(dtype=float), rows[label].to_numpy(dtype=float)


@dataclass(frozen=True)
class Stump:
    feature: str
    threshold: float
    low: float
    high: float


@dataclass(frozen=True)
class StumpModel:
    """Log-odds at the start, then stumps at a learning rate."""

    start: float
    rate: float
    stumps: tuple[Stump, ...]

    def probability(self) -> Column:
        total = F.lit(self.start)
        for s in self.stumps:
            total = total + self.rate * F.when(F.col(s.feature) <= s.threshold, s.low).otherwise(s.high)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), total))))

    def score(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("score", self.probability())

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> StumpModel:
        d = json.loads(text)
        return cls(d["start"], d["rate"], tuple(Stump(**s) for s in d["stumps"]))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> StumpModel:
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])


def cut_points(values: np.ndarray, most: int = 15) -> np.ndarray:
    """Middles between distinct values; quantiles of them where there are many."""
    distinct = np.unique(values)
    if len(distinct) <= 1:
        return np.zeros(0)
    return np.quantile(distinct, np.linspace(0.05, 0.95, most)) if len(distinct) > most else (distinct[:-1] + distinct[1:]) / 2


def fit_stumps(x: np.ndarray, y: np.ndarray, features: list[str], rounds: int = 50, rate: float = 0.1) -> StumpModel:
    """Gradient boosting with one split a round: the split whose two means explain most of the residuals' squares.

    Each feature is held as the number of the bin between its cut points, one byte a row; a round needs the bins' sums.
    """
    p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    start = float(np.log(p / (1 - p)))
    total = np.full(len(y), start)
    cuts = [cut_points(x[:, j]) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], side="left").astype(np.uint8) for j, c in enumerate(cuts)]
    low_counts = [np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1] for b, c in zip(bins, cuts, strict=True)]
    found: list[Stump] = []
    for _ in range(rounds):
        residual = y - 1 / (1 + np.exp(-np.clip(total, -20, 20)))
        whole, best = residual.sum(), (-1.0, 0, 0, 0.0, 0.0)
        for j, (b, c, low_n) in enumerate(zip(bins, cuts, low_counts, strict=True)):
            usable = np.flatnonzero((low_n > 0) & (low_n < len(y)))
            if not len(usable):
                continue
            low = np.cumsum(np.bincount(b, weights=residual, minlength=len(c) + 1))[usable]
            n = low_n[usable]
            gain = low**2 / n + (whole - low) ** 2 / (len(y) - n)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), j, int(usable[i]), float(low[i] / n[i]), float((whole - low[i]) / (len(y) - n[i])))
        if best[0] < 0:
            break
        _, j, at, low_mean, high_mean = best
        found.append(Stump(features[j], float(cuts[j][at]), low_mean, high_mean))
        total += rate * np.where(bins[j] <= at, low_mean, high_mean)
    return StumpModel(start, rate, tuple(found))


@dataclass(frozen=True)
class LogisticModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def probability(self) -> Column:
        total = F.lit(self.bias)
        for name, w in zip(self.features, self.weights, strict=True):
            total = total + F.col(name) * w
        return 1 / (1 + F.exp(-F.greatest(F.lit(-25.0), F.least(F.lit(25.0), total))))

    def score(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("score", F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), self.probability())))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogisticModel:
        d = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls(tuple(d["features"]), tuple(d["weights"]), d["bias"])


def balanced(pairs: DataFrame, label: str, name: str) -> DataFrame:
    """Adds weights that give both classes the same sum."""
    n, ones = pairs.agg(F.count("*"), F.sum(F.col(label).cast("long"))).first()
    ones = ones or 0
    return pairs.withColumn(name, F.when(F.col(label) == 1, n / (2 * max(1, ones))).otherwise(n / (2 * max(1, n - ones))))


def fit_logistic(pairs: DataFrame, features: list[str], label: str = "label", l2: float = 1e-4, rounds: int = 100) -> LogisticModel:
    """Logistic regression on all labelled pairs, both classes with the same weight."""
    rows = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep").transform(balanced(pairs, label, "_weight"))
    model = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", regParam=l2, maxIter=rounds).fit(rows.select("_features", label, "_weight"))
    return LogisticModel(tuple(features), tuple(map(float, model.coefficients.toArray())), float(model.intercept))


class FallbackMatcher:
    """The geometric mean of name and address likeness, for want of a fitted model."""

    def score(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("score", F.col("combined_geom_sim"))


class RuleMatcher:
    """The weighted rules; needs all pair features."""

    def score(self, pairs: DataFrame) -> DataFrame:
        from linkloom.operators.pairs import rule_score

        return pairs.withColumn("score", rule_score(agreement=F.col("strong_agreement") == 1))


# Trees.


ROUNDS = 100


def tree_pipeline(features: list[str], label: str = "label", rounds: int = ROUNDS, depth: int = 5, rate: float = 0.15, seed: int = 7, held: str | None = None) -> Pipeline:
    """Boosted trees; with ``held``, a column that marks rows to validate on, boosting stops when they gain no more."""
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=0.8, validationTol=0.01)
    return Pipeline(stages=[assembler, trees.setValidationIndicatorCol(held) if held else trees])


def fit_trees(pairs: DataFrame, features: list[str], train: Column, rounds: int = ROUNDS, rate: float = 0.15) -> object:
    """Trees of the rows that ``train`` marks and is_val doesn't; is_val rows stop them, if there are any."""
    rows = pairs.where(train | F.col("is_val"))
    held = "is_val" if not pairs.where("is_val").isEmpty() else None
    return tree_pipeline(features, rounds=rounds, rate=rate, held=held).fit(rows)


def with_probability(model, pairs: DataFrame, name: str) -> DataFrame:
    scored = model.transform(pairs).withColumn(name, vector_to_array("probability")[1])
    return scored.drop("_features", "rawPrediction", "probability", "prediction")


def stage1(pairs: DataFrame, features: list[str], rounds: int = ROUNDS) -> tuple[object, object]:
    """Two models, one for each half of the training queries (qhash below 500, and above)."""
    return tuple(fit_trees(pairs, features, when, rounds) for when in (F.col("qhash") < 500, F.col("qhash") >= 500))


def stage1_probability(models, pairs: DataFrame) -> DataFrame:
    """p1: of the model that hasn't seen a training pair; of both, on average, for the rest."""
    df = with_probability(models[1], with_probability(models[0], pairs, "_p0"), "_p1")
    mean = (F.col("_p0") + F.col("_p1")) / 2
    return df.withColumn("p1", F.when(F.col("is_val"), mean).when(F.col("qhash") < 500, F.col("_p1")).otherwise(F.col("_p0"))).drop("_p0", "_p1")


def feature_importance(model, features: list[str], most: int = 25) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:most]


def threshold_scores(best: DataFrame, truth: DataFrame, grid: list[float], p: str = "p") -> DataFrame:
    """(thr, f): macro F0.5 at each threshold of a grid.

    best: (s1_id, cand_id, p), one parent for each record; truth: (s1_id, ids) of all parents.
    """
    c = F.col
    steps = F.array(*map(F.lit, sorted(grid)))
    rows = best.join(truth.select("s1_id", "ids"), "s1_id", "left").select("s1_id", F.col(p).alias("p"), F.coalesce(F.array_contains("ids", c("cand_id")), F.lit(False)).cast("int").alias("hit"))
    per = rows.select("s1_id", "hit", F.explode(F.filter(steps, lambda t: t <= c("p"))).alias("thr")).groupBy("s1_id", "thr").agg(F.count("*").alias("n"), F.sum("hit").alias("tp"))
    parents = truth.select("s1_id", F.size("ids").alias("n_true"), F.explode(steps).alias("thr")).join(per, ["s1_id", "thr"], "left").fillna({"n": 0, "tp": 0})
    precision, recall = c("tp") / F.nullif(c("n"), F.lit(0)), c("tp") / F.nullif(c("n_true"), F.lit(0))
    f = F.when((c("n") == 0) & (c("n_true") == 0), 1.0).when(c("tp") == 0, 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))
    return parents.groupBy("thr").agg(F.avg(f).alias("f"))


def tune_threshold(best: DataFrame, truth: DataFrame, grid: list[float], p: str = "p") -> list[tuple[float, float]]:
    """The rows of threshold_scores, one for each threshold."""
    return [(r["thr"], r["f"]) for r in threshold_scores(best, truth, grid, p).orderBy("thr").collect()]


def search_threshold(best: DataFrame, truth: DataFrame, p: str = "p") -> tuple[float, float]:
    """The threshold with the best macro F0.5, sought by twentieths, then by hundredths around the best of these; the higher of equals."""
    pick = lambda grid: max(tune_threshold(best, truth, grid, p), key=lambda x: (x[1], x[0]))
    coarse, _ = pick([i / 20 for i in range(1, 20)])
    return pick([round(coarse + i / 100, 2) for i in range(-4, 5) if 0 < coarse + i / 100 < 1])


# URL model.

def training_urls() -> list[tuple[str, int]]:
    """Made-up addresses for the default model: pages of registered domains, and traps that pair brands with bad hosts."""
    registered = list(url_functions.REGISTRY)
    pages = ("", "about", "docs/intro.html", "search?q=weather+today", "2024/05/article-17")
    benign = [f"https://{domain}/{pages[i % len(pages)]}" for i, domain in enumerate(registered)]
    words, tlds = url_functions.SUSPICIOUS_TOKENS, url_functions.SUSPICIOUS_TLDS
    traps = []
    for i, brand in enumerate(url_functions.BRANDS):
        one, two, tld = words[i % len(words)], words[(i * 7 + 3) % len(words)], tlds[i % len(tlds)]
        traps += [f"http://{brand}-{one}-{two}.{tld}/{one}", f"http://10.{i}.2.3/{brand}/{one}/{two}.php", f"http://{one}.{two}.{brand}.session{i}.{tld}/x?id={i * 7919}"]
    return [(u, 0) for u in benign] + [(u, 1) for u in traps]


_url_models: dict[tuple[str, int], object] = {}


def url_model(spark: SparkSession, seed: int = 42, path: str | None = None):
    """Scaled features into a forest of 30 trees, fitted on training_urls(): once for each application, or read from ``path`` if it is there."""
    known = (spark.sparkContext.applicationId, seed)
    if path is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return PipelineModel.load(path)
    if known not in _url_models:
        data = url_vectors(spark.createDataFrame(training_urls(), "url string, label int"))
        stages = [VectorAssembler(inputCols=url_functions.VECTOR, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=30, maxDepth=6, seed=seed)]
        _url_models[known] = Pipeline(stages=stages).fit(data)
    if path is not None:
        _url_models[known].save(path)
    return _url_models[known]


def url_scorer(model) -> Callable[[DataFrame], DataFrame]:
    """Adds model_score to URLs with their features."""

    def run(featured: DataFrame) -> DataFrame:
        flags = [f for f, t in featured.select(*url_functions.VECTOR).dtypes if t == "boolean"]
        numbers = featured.withColumns({f: F.col(f).cast("int") for f in flags})
        scored = with_probability(model, numbers, "model_score").drop("_raw").withColumn("model_score", F.round("model_score", 4))
        return scored.withColumns({f: F.col(f) == 1 for f in flags})

    return run


def url_vectors(df: DataFrame) -> DataFrame:
    """URLs with all features, flags as numbers."""
    out = url_functions.features(url_functions.tokenize(df))
    flags = [f for f, t in out.select(*url_functions.VECTOR).dtypes if t == "boolean"]
    return out.withColumns({f: F.col(f).cast("int") for f in flags})


def url_predictions(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df with model_score, heuristic_score, threat_score, is_malicious, risk_level, confidence, detected_threats."""
    scored = with_probability(model, url_vectors(df), "model_score").drop("_raw").withColumn("model_score", F.round("model_score", 4))
    scored = scored.withColumns({f: F.col(f) == 1 for f in ("is_ip", "has_suspicious_tld")})
    return url_functions.assess(url_functions.heuristics(scored), threshold)
