"""Toxicity by a chain of classifiers.

Categories are predicted in turn by linear models over the hashed words of a text; each later model also sees the
probabilities that the models before it gave. They are trained with out-of-fold predictions: a training row's
probability comes from a model that has not seen the row, as it will be for new rows.

Training takes the labelled rows, thinned out by a hash of the id to about ``sample`` of them (a classifier may be
fitted on a bounded sample), so that a fit is the work of one task and the fits of the folds run side by side; every
document is scored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from dqwatch.llm.common import map_columns, read, written

FEATURES = 1 << 17
FOLDS = 4
SAMPLE = 10_000
THRESHOLD = 0.5
STEPS, RATE, L2 = 200, 0.05, 1e-4
STEMS = (4, 6)
#: Rows that must hold a feature, and its least chi-square with the label; others would only be learnt by heart.
MIN_ROWS, MIN_CHI2 = 5, 15.0
_WORD = re.compile(r"[^\W_]+")


def features(text: str | None) -> np.ndarray:
    """Hash values of the distinct words of a text and of their beginnings; null is empty.

    Beginnings stand for stems: inflected words share them.
    """
    words = set(_WORD.findall((text or "").lower()))
    words |= {f"{w[:n]}-" for n in STEMS for w in words if len(w) > n}
    return np.unique(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES for w in words], dtype=np.int64))


def fit(rows: list[np.ndarray], before: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression (words, then earlier categories, then the constant) by Adam over all rows.

    Without rows, or with one label only, only the constant is set: to the smoothed share of ones.
    """
    n, chained = before.shape if len(rows) else (0, 0)
    weights = np.zeros(FEATURES + chained + 1)
    share = (labels.sum() + 0.5) / (n + 1)
    weights[-1] = np.log(share / (1 - share)) if n else -20.0
    if not n or labels.min() == labels.max():
        return weights
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    held, with_one = np.bincount(flat, minlength=FEATURES), np.bincount(flat, labels[row], FEATURES)
    ones = labels.mean()
    spread = np.maximum(held * ones * (1 - ones) * (1 - held / n), 1e-9)
    kept = ((held >= MIN_ROWS) & ((with_one - held * ones) ** 2 / spread >= MIN_CHI2))[flat]
    flat, row = flat[kept], row[kept]
    mean, slope = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        margin = np.bincount(row, weights[flat], n) + before @ weights[FEATURES:-1] + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / n
        gradient = np.concatenate([np.bincount(flat, error[row], FEATURES), error @ before, [error.sum()]])
        gradient[:-1] += L2 * weights[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        slope = 0.99 * slope + 0.01 * gradient**2
        weights -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(slope / (1 - 0.99**step)) + 1e-8)
    return weights


def probability(row: np.ndarray, before: list[float], weights: np.ndarray) -> float:
    margin = weights[row].sum() + float(np.dot(before, weights[FEATURES:-1])) + weights[-1]
    return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


@dataclass
class Chain:
    """Categories in their order, and the weights of each one's model."""

    categories: list[str]
    weights: list[np.ndarray]


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """Fit the chain on documents that ``labels`` (doc_id and a 0/1 column per category) covers.

    Rows with a null label or id are not used; of several labels of one document the largest holds. Without labels
    all probabilities are 0; one value throughout gives its smoothed share.
    """
    known = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in categories]).na.drop()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    count = known.count()
    if count > sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / count))

    def featured(*columns: list) -> list[list]:
        return [columns[0], [features(t).tolist() for t in columns[1]], [[] for _ in columns[0]], *columns[2:]]

    types = "".join(f", {c} int" for c in categories)
    # the labelled ids are bounded by ``sample``: a few hundred KB
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", *categories)
    rows = map_columns(labelled, "doc_id long, row array<int>, before array<double>" + types, featured)
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int")), "labelled")
    weights = []
    for category in categories:
        last = category == categories[-1]

        def fit_model(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            order = part.sort_values("doc_id")
            found = fit(
                [np.asarray(r, dtype=np.int64) for r in order.row],
                np.array(order.before.tolist(), dtype=float).reshape(len(order), -1),
                order.label.to_numpy(dtype=float),
            )
            return pd.DataFrame({"model": [int(key[0])], "weights": [found.tobytes()]})

        # model k leaves fold k out; model ``folds`` sees all and is the one that is kept
        wanted = [folds] if last else list(range(folds + 1))
        dealt = rows.withColumn("model", F.explode(F.array(*[F.lit(k) for k in wanted]))).filter("model <> fold").withColumn("label", F.col(category))
        fitted = {r.model: np.frombuffer(r.weights) for r in dealt.groupBy("model").applyInPandas(fit_model, "model int, weights binary").collect()}
        chained = len(weights)
        weights.append(fitted.get(folds, fit([], np.empty((0, 0)), np.empty(0))))
        if len(weights[-1]) != FEATURES + chained + 1:
            weights[-1] = np.concatenate([np.zeros(FEATURES + chained), weights[-1][-1:]])
        if not last:
            empty = np.concatenate([np.zeros(FEATURES + chained), [-20.0]])

            def unseen(before: list, row: list, fold: list, *rest: list, models: dict = fitted, none: np.ndarray = empty) -> list[list]:
                added = [
                    [*b, probability(np.asarray(r, dtype=np.int64), b, models.get(f, none))]
                    for b, r, f in zip(before, row, fold, strict=True)
                ]
                return [added, row, fold, *rest]

            columns = rows.select("before", "row", "fold", "doc_id", *categories)
            rows = written(map_columns(columns, columns.schema, unseen), "out_of_fold")
    return Chain(categories, weights)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category> for each category) of every row of (doc_id, text); null and empty texts have no words."""

    def run(ids: list, texts: list) -> list[list]:
        out: list[list] = [ids, *[[] for _ in chain.categories]]
        for text in texts:
            row, before = features(text), []
            for column, weights in zip(out[1:], chain.weights, strict=True):
                before.append(probability(row, before, weights))
                column.append(before[-1])
        return out

    return map_columns(docs.select("doc_id", "text"), "doc_id long" + "".join(f", p_{c} double" for c in chain.categories), run)


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose last category stays below the threshold; all columns stay."""
    at = docs.columns.index("text")

    def run(*columns: list) -> list[list]:
        kept = []
        for i, text in enumerate(columns[at]):
            row, before = features(text), []
            for weights in chain.weights:
                before.append(probability(row, before, weights))
            if before[-1] < threshold:
                kept.append(i)
        return [[c[i] for i in kept] for c in columns]

    return map_columns(docs, docs.schema, run)


def corpus_chain(spark: SparkSession, sf_dir: str) -> Chain:
    """Low quality first, then toxicity, from ``labels`` and ``documents``."""
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic").withColumn("low_quality", 1 - F.col("quality"))
    return train_chain(read(spark, sf_dir, "documents", "doc_id", "text"), labels, ["low_quality", "toxic"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of every document, and whether it counts as toxic."""
    found = score(read(spark, sf_dir, "documents", "doc_id", "text"), corpus_chain(spark, sf_dir))
    return found.withColumn("toxic", (F.col("p_toxic") >= THRESHOLD).cast("int"))
