"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words, and beginnings of words, that a text holds
is trained from confirmed
toxic texts and unlabelled ones. The risk of calling clean texts toxic can't be
measured on unlabelled texts, of which a share pi is toxic; it is estimated as
R_u(-) - pi R_p(-), and kept from falling below zero, where a flexible model
would overfit. Scores come from the fitted logit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .folds import held_out, lowest_hashed
from .scratch import materialize
from .textops import NOT_ALNUM, Words, distinct_by_doc, word_slices
from .worker import tidy

#: Texts that are learned from: confirmed toxic ones, and unlabelled ones.
POSITIVES, UNLABELLED = 4000, 12000
#: Features of the classifier; each is in MIN_SHARE of the toxic texts at least (and
#: in two), and exceeds its rate in all texts by MIN_Z standard deviations.
FEATURES, MIN_SHARE, MIN_Z = 2048, 0.004, 4.5
STEPS, RATE, DECAY = 400, 0.1, 3e-4
THRESHOLD = 0.5
#: Bytes of a word's beginnings that are features.
PREFIXES = (4, 5, 6)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weight: np.ndarray
    bias: float

    def logits(self, h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """h, doc: distinct words of each document."""
        if not len(self.words):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.bincount(doc, np.where(self.words[at] == h, self.weight[at], 0.0), minlength=n) + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """From the distinct word hashes of texts of both kinds, and the share of toxic texts."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -4.0)
    n_p, n_u = len(positive), len(unlabelled)
    words, count = np.unique(np.concatenate(positive), return_counts=True)
    enough = count >= max(2, MIN_SHARE * n_p)
    words, count = words[enough], count[enough]
    every = np.concatenate(unlabelled)
    every = every[np.isin(every, words)]
    u = np.bincount(np.searchsorted(words, every), minlength=len(words))
    # excess of a word's rate in toxic texts over all texts, in standard deviations
    rate = (count + u + 1) / (n_p + n_u + 2)
    z = (count / n_p - u / n_u) / np.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u))
    best = np.argsort(-z, kind="stable")[:FEATURES]
    words = np.sort(words[best[z[best] > MIN_Z]])
    if not len(words):
        return Model(words, np.zeros(0), -4.0)
    docs = positive + unlabelled
    h, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = words[at] == h
    at, doc = at[hit], doc[hit]
    w, b = np.zeros(len(words)), -1.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, STEPS + 1):
        s = _sigmoid(np.bincount(doc, w[at], minlength=n_p + n_u) + b)
        loss_minus = -np.log1p(-np.minimum(s, 1 - 1e-9))
        negative = loss_minus[n_p:].mean() - prior * loss_minus[:n_p].mean()
        g = np.empty(n_p + n_u)
        g[:n_p] = prior * (s[:n_p] - 1) / n_p  # toxic texts called clean
        sign = 1.0 if negative >= 0 else -1.0  # below zero: step back
        if sign < 0:
            g[:n_p] = 0
        g[:n_p] -= sign * prior * s[:n_p] / n_p
        g[n_p:] = sign * s[n_p:] / n_u
        grad = np.append(np.bincount(at, g[doc], minlength=len(w)) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(words, w, float(b))


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    parts = [(words.hash, words.doc), *(words.prefixes(n) for n in PREFIXES)]
    return np.concatenate([h for h, _ in parts]), np.concatenate([d for _, d in parts])


@tidy
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each kind that hold a word, summed within a slice."""
    for batch in batches:
        flags = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (1, 2)]
        for a, b, words in word_slices(batch.column(3), between=NOT_ALNUM):
            h, doc = distinct_by_doc(*_features(words))
            each, at = np.unique(h, return_inverse=True)
            p, u = (np.bincount(at, f[a:b][doc], minlength=len(each)).astype(np.int64) for f in flags)
            yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(p), pa.array(u)], ["word", "p", "u"])


def _held(chosen):
    """The chosen words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chosen.value
        for batch in batches:
            for a, b, words in word_slices(batch.column(3), between=NOT_ALNUM):
                h, doc = _features(words)
                hit = np.isin(h, known)
                h, doc = distinct_by_doc(h[hit], doc[hit])
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=words.n_docs))])
                rows = pa.array([h[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), rows], ["doc_id", "p", "u", "words"])

    return tidy(run)


def _telling(sample: DataFrame, n_p: int, n_u: int) -> np.ndarray:
    """The words that ``fit`` would choose, counted by the cluster: FEATURES at most."""
    counts = sample.mapInArrow(_counts, "word long, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n_u))
    best = counts.filter(F.col("p") >= max(2, MIN_SHARE * n_p)).select("word", z.alias("z")).filter(F.col("z") > MIN_Z - 1e-6)
    return np.sort(np.array([r.word for r in best.orderBy(F.desc("z"), "word").limit(FEATURES).collect()], np.int64).view(np.uint64))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on bounded samples of the learning fold, whole texts.

    The driver gets the sample's ids, FEATURES words, and which text holds which of them.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out() & F.col("toxic").isNotNull())
    share = marked.agg(F.avg("toxic")).first()[0]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(~held_out() & F.col("doc_id").isNotNull())
    toxic = {r.doc_id for r in lowest_hashed(marked.filter("toxic = 1").select("doc_id").distinct(), POSITIVES).collect()}
    plain = {r.doc_id for r in lowest_hashed(base.select("doc_id").distinct(), UNLABELLED, seed=11).collect()}
    if share is None or not toxic or not plain:
        return fit([], [], 0.0)
    chosen = spark.createDataFrame([(i, i in toxic, i in plain) for i in sorted(toxic | plain)], "doc_id long, p boolean, u boolean")
    # One text for each id; the sample is read twice, the documents once.
    sample = base.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "p", "u").agg(F.max("text").alias("text"))
    sample = materialize(sample, "toxicity-sample")
    n_p, n_u = sample.agg(F.count_if("p"), F.count_if("u")).first()
    if not n_p or not n_u:
        return fit([], [], 0.0)
    words = spark.sparkContext.broadcast(_telling(sample, n_p, n_u))
    rows = sample.mapInArrow(_held(words), "doc_id long, p boolean, u boolean, words binary").collect()
    read = [(r.p, r.u, np.frombuffer(bytes(r.words), np.uint64)) for r in sorted(rows, key=lambda r: r.doc_id)]
    return fit([w for p, _, w in read if p], [w for _, u, w in read if u], min(max(share, 0.001), 0.9))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        maybe = np.zeros(1 << 16, bool)
        maybe[(m.words & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            for a, b, words in word_slices(batch.column(1), between=NOT_ALNUM):
                h, doc = _features(words)
                hit = maybe[(h & np.uint64(0xFFFF)).astype(np.int64)]
                h, doc = distinct_by_doc(h[hit], doc[hit])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(_sigmoid(m.logits(h, doc, words.n_docs)))], ["doc_id", "score"])

    return tidy(run)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of each row of (doc_id, text).

    A null or empty text has the score of a text without any of the model's
    words. Repeated rows stay; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labelled fold, then score every row."""
    return score(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
