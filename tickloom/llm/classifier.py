"""Quality classifier by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (a document of label 1 over one of label 0). The model is a linear score
w.f(text); w maximises the likelihood of the preferences, a logistic loss on feature differences with an L2 penalty,
by Newton's method. The decision threshold is a quantile of the training scores: the one at which the fewest training
documents are misjudged. Scores are mapped to (0, 1) by a logistic curve that gives the threshold the value `cut`.

Features of a text (all from the whole text, none from other columns; they describe its surface, no word is looked up): shares of its bytes by class (each ASCII
punctuation mark, upper case, lower case, digits, spaces, line feeds, other bytes), the share of distinct words, of the
most repeated word, of words equal to the one before, of repeated lines, mean word length, each with its square root,
and the logarithm of the length.

Fitting reads at most max_labels labelled rows (those with the smallest hashes of doc_id; a documented bound on what
reaches the driver: max_labels x 90 doubles); scoring reads every document. The weights are fitted to `pairs` (30,000)
preference pairs drawn from these rows with replacement, a second bound: with few rows of one label their draws repeat,
and rows may stay undrawn. Scaling and threshold use all training rows.

Defined cases: null text counts as empty, an empty text has all shares 0 and a finite score; repeated labels of a
document count each; of several documents with one doc_id the least text is learned from, and each is scored; null or other labels than 0 and 1 are left out; if either label is missing from the training rows
all weights are 0 and every document is kept; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.full(256, len(PUNCTUATION), np.int64)  # other bytes
for _i, _c in enumerate(PUNCTUATION):
    _CLASS[_c] = _i
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 13), (10,)), 1):
    for _c in _chars:
        _CLASS[_c] = len(PUNCTUATION) + _i
N_CLASSES = len(PUNCTUATION) + 6


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    if not data:
        return np.zeros(2 * (N_CLASSES + 5) + 1)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.bincount(_CLASS, by_byte, N_CLASSES) / len(data)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    codes = np.fromiter((hash(w) for w in words), np.int64, len(words))
    _, times = np.unique(codes, return_counts=True) if len(words) else (None, np.zeros(1))
    rest = (len(times) / n, times.max() / n, np.count_nonzero(codes[1:] == codes[:-1]) / n, 1 - len(set(lines)) / len(lines), min(1.0, len(data) / n / 30))
    x = np.concatenate([shares, rest])
    return np.concatenate([x, np.sqrt(x), [np.log1p(len(data)) / 12]])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.threshold) / self.spread + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, cut: float = 0.3, pairs: int = 30_000, l2: float = 1e-3, seed: int = 1) -> Model:
    """Fits a Model to features x and labels y (0/1)."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Model(mean, scale, w, -1.0, 1.0, cut)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) / pairs - l2 * w
        curvature = (d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.sort(s)
    # Errors if everything below the k-th score is rejected.
    lost, passed = np.searchsorted(np.sort(s[good]), order), len(bad) - np.searchsorted(np.sort(s[bad]), order)
    k = int(np.argmin(lost + passed))
    threshold = order[0] - 1e-9 if k == 0 else (order[k - 1] + order[k]) / 2
    return Model(mean, scale, w, float(threshold), float(max(1e-9, s.std() / 2)), cut)


FEATURES = "x array<double>"


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """keep columns and x, the features of each text."""

    @F.pandas_udf("array<double>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series([features(t) for t in text], dtype=object)

    return docs.select(*keep, of("text").alias("x"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labels: int = 8_000, cut: float = 0.3) -> Model:
    """Fits on the labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most max_labels of them."""
    rows = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("label"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    # A label row gives one row however many documents have its doc_id: partial minima first, so none of them meet.
    rows = rows.groupBy("doc_id", "label").agg(F.count("*").alias("times"))
    one = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label", "times").agg(F.min("text").alias("text"))
    got = with_features(one, "label", "doc_id", "times").toPandas()
    got = got.sort_values(["doc_id", "label"], kind="stable")
    got = got.loc[got.index.repeat(got["times"])]
    x = np.array(got["x"].tolist(), float).reshape(len(got), 2 * (N_CLASSES + 5) + 1)
    return fit(x, got["label"].to_numpy(), cut)


def classify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep columns, score, predicted of every document."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            x = np.array([features(t) for t in text]).reshape(len(text), -1)
            yield pd.Series(model.score(x) if len(x) else [], dtype=float)

    return docs.select(*keep, score("text").alias("score")).withColumn("predicted", F.when(F.col("score") >= model.cut, 1).otherwise(0))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(docs, train(docs, labels), "doc_id")
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select("text", F.struct(*docs.columns).alias("doc"))  # so that no name of theirs meets one of ours
    return classify(whole, model, "doc").where("predicted = 1").select("doc.*")
