"""Severity of toxic language by cumulative-link ordinal regression.

The model has one weight per word (hashed to ``FEATURES`` classes) and one
ascending threshold per step of severity: P(grade > k) = sigmoid(w x - t_k).
All steps share the weights.  x marks which words a text holds; the whole text
counts.  A text's severity is the expected grade, the sum of P(grade > k).

Grades of the labelled documents: 0 is not toxic; the toxic ones are put into
grades 1 to 3 by how many different words they hold that are typical of toxic
documents (by log odds), a third each.  Weights are fitted on at most
``PER_LABEL`` documents of either label, those with the smallest hashes of
doc_id, by accelerated proximal gradient steps with an L1 penalty, which
leaves weights only on words that matter.

Cases: a text that holds no word that speaks for toxicity, so also one that is
null or without words, has severity 0.  Without labelled
documents of both kinds the severity of every text is 0.  Labels that are null
are not used; of several labels of a document the larger one counts, and of
several texts each is an example.  Of ``docs`` the fit reads the id and the text
only; columns called as the results are replaced.  An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meander.llm.common import binaries, slices
from meander.llm.words import Words, text_of

FEATURES, PER_LABEL, GRADES = 1 << 20, 4000, 4
LEAST_DOCS, TYPICAL = 5, 2.0
PENALTY, STEPS = 5e-4, 400
REJECT = 0.5


@dataclass(frozen=True)
class OrdinalModel:
    """words: sorted classes with a weight; thresholds ascend."""
    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def ordinal_loss(score: np.ndarray, grade: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss, its slope by score, and by threshold."""
    edge = np.r_[-np.inf, t, np.inf]
    hi, lo = _sigmoid(edge[grade + 1] - score), _sigmoid(edge[grade] - score)
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi), lo * (1 - lo)
    n, k = len(score), len(t)
    by_t = -(np.bincount(grade, dhi / p, k + 1)[:k] - np.bincount(grade, dlo / p, k + 1)[1:]) / n
    return -np.log(p).mean(), (dhi - dlo) / p / n, by_t


def grades_of(owner: np.ndarray, word: np.ndarray, toxic: np.ndarray, grades: int) -> np.ndarray:
    """0, or for toxic documents 1 .. grades - 1 by their number of typical words."""
    bad = np.bincount(word, toxic[owner], FEATURES) + 0.5
    good = np.bincount(word, 1 - toxic[owner], FEATURES) + 0.5
    odds = np.log(bad / (toxic.sum() + 1)) - np.log(good / ((1 - toxic).sum() + 1))
    typical = (odds > TYPICAL) & (bad + good > LEAST_DOCS)
    count = np.bincount(owner, typical[word], len(toxic))
    steps = np.quantile(count[toxic == 1], np.arange(1, grades - 1) / (grades - 1), method="lower")
    return np.where(toxic == 1, 1 + (count[:, None] > steps).sum(1), 0)


def fit_ordinal(owner: np.ndarray, word: np.ndarray, grade: np.ndarray, grades: int = GRADES, penalty: float = PENALTY,
                steps: int = STEPS) -> OrdinalModel:
    """owner, word: which document holds which word class, each pair once."""
    n = len(grade)
    names, column, count = np.unique(word, return_inverse=True, return_counts=True)
    use = (count >= LEAST_DOCS) & (count <= n / 2)
    keep = use[column]
    row, column = owner[keep], (np.cumsum(use) - 1)[column[keep]]
    names, width = names[use], int(use.sum())
    forward = lambda w: np.bincount(row, w[column], n)
    backward = lambda g: np.bincount(column, g[row], width)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n, 1e-3, 1 - 1e-3)
    t = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    w = np.zeros(width)
    if width:
        v = np.ones(width)
        for _ in range(20):
            v = backward(forward(v))
            v /= np.linalg.norm(v)
        rate = 1 / (0.5 * np.linalg.norm(forward(v)) ** 2 / n + 1e-9)
        ahead, pace = w, 1.0
        for _ in range(steps):
            _, by_score, by_t = ordinal_loss(forward(ahead), grade, t)
            # No threshold may pass its neighbour.
            t = np.maximum.accumulate(t - 2.0 * by_t)
            step = ahead - rate * backward(by_score)
            new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead, w, pace = new + (pace - 1) / faster * (new - w), new, faster
    kept = w != 0
    return OrdinalModel(names[kept].astype(np.int64), w[kept], t)


def _classes(words: Words) -> np.ndarray:
    return (words.hash & np.uint64(FEATURES - 1)).astype(np.int64)


def _features(batches):
    for batch in slices(batches, "text"):
        words = Words(batch.column(0), lower=True, letters=True)
        both = np.unique(text_of(words.first) * FEATURES + _classes(words))
        yield pa.record_batch([batch.column(1), binaries((both % FEATURES).astype(np.int32), np.searchsorted(both // FEATURES, np.arange(batch.num_rows + 1)))],
                              ["toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, grades: int = GRADES, doc_id: str = "doc_id",
        text: str = "text", toxic: str = "toxic") -> OrdinalModel | None:
    """The model, from at most 2 ``per_label`` labelled documents; None if a label has no document."""
    one = (labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("__id"))
           .agg(F.max((F.col(toxic) > 0).cast("int")).alias("toxic")).where("toxic is not null"))
    some = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("__id"), "__id").limit(per_label) for k in (0, 1)]
    texts = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(some[0].unionByName(some[1])), "__id")
    found = sample.select("text", "toxic").mapInArrow(_features, "toxic int, words binary").collect()
    y = np.array([r["toxic"] for r in found], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    lists = [np.frombuffer(r["words"], np.int32) for r in found]
    owner, word = np.repeat(np.arange(len(y)), [len(x) for x in lists]), np.concatenate(lists).astype(np.int64)
    return fit_ordinal(owner, word, grades_of(owner, word, y, grades), grades)


def severity(model: OrdinalModel | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade > 0) of each text."""
    n = len(words.counts)
    if model is None:
        return np.zeros(n), np.zeros(n)
    table = np.zeros(FEATURES)
    table[model.words] = model.weights
    classes, owner = _classes(words), text_of(words.first)
    some = np.flatnonzero(table[classes])
    both = np.unique(owner[some] * FEATURES + classes[some])
    score = np.bincount(both // FEATURES, table[both % FEATURES], n)
    held = np.bincount(both // FEATURES, table[both % FEATURES] > 0, n) > 0
    above = _sigmoid(score[:, None] - model.thresholds) * held[:, None]
    return above.sum(1), above[:, 0]


def score(docs: DataFrame, model: OrdinalModel | None, text: str = "text") -> DataFrame:
    """``docs`` with severity, grade (most likely thresholds passed) and toxic added, in place of columns so called."""
    docs = docs.drop("severity", "grade", "toxic")
    keep = docs.columns
    at = keep.index(text)

    def run(batches):
        for batch in slices(batches, text):
            words = Words(batch.column(at), lower=True, letters=True)
            expected, above = severity(model, words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(np.rint(expected).astype(np.int32)), pa.array(above >= REJECT)],
                                             [*keep, "severity", "grade", "toxic"])
    from pyspark.sql import types as T
    shape = T.StructType([*docs.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])
    return docs.mapInArrow(run, shape)


def drop_toxic(docs: DataFrame, model: OrdinalModel | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't take for toxic, with their columns."""
    at, shape = docs.columns.index(text), docs.schema

    def run(batches):
        for batch in slices(batches, text):
            _, above = severity(model, Words(batch.column(at), lower=True, letters=True))
            yield batch.filter(pa.array(above < REJECT))
    return docs.mapInArrow(run, shape)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).select("doc_id", "severity", "grade", "toxic")
