"""Quality by a sparse rule ensemble over text statistics.

Small regression trees are boosted on the labels; every path of a tree is a
conjunction of bounds on statistics, a rule. A logistic model with a lasso
penalty weighs the rules and leaves few of them, and these compile into one
Spark column expression over the statistics, which the scan evaluates without
Python. Statistics are counted over whole texts, byte-wise in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .folds import held_out, lowest_hashed
from .scratch import materialize
from .textops import distinct_by_doc, word_slices
from .worker import tidy

#: Labelled documents that are learned from.
SAMPLE = 20_000
TREES, DEPTH, RATE, LEAF, BINS = 30, 3, 0.2, 10, 32
LASSO, LASSO_STEPS = 0.002, 600
THRESHOLD = 0.3

STATISTICS = (
    "n_words", "mean_word", "upper_share", "digit_share", "symbol_share", "comma_share", "bang_share", "bar_share",
    "distinct_share", "repeat_share", "line_repeat_share", "words_per_line", "long_share",
)


def _classes() -> dict[str, np.ndarray]:
    def of(chars: bytes) -> np.ndarray:
        out = np.zeros(256, bool)
        out[list(chars)] = True
        return out

    return {
        "upper_share": of(bytes(range(65, 91))), "digit_share": of(bytes(range(48, 58))), "symbol_share": of(b"#*$%&<>@^~=_\\{}[]"),
        "comma_share": of(b".,;:"), "bang_share": of(b"!?"), "bar_share": of(b"|"),
    }


_CLASSES = _classes()


def _per_doc(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return np.diff(total[edges])


def _lines(words) -> np.ndarray:
    """Of the lines with a word, how many equal an earlier one of the document; and all such lines."""
    newline = np.flatnonzero(words.data == 10)
    line = np.searchsorted(newline, words.start)
    key = line + words.doc  # a document's first words start a line
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (words.doc[1:] != words.doc[:-1])])) if len(key) else np.zeros(0, int)
    if not len(starts):
        return np.zeros(words.n_docs), np.zeros(words.n_docs)
    place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    h = np.add.reduceat(words.hash * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)), starts)
    doc = words.doc[starts]
    every = np.bincount(doc, minlength=words.n_docs)
    return every - np.bincount(distinct_by_doc(h, doc)[1], minlength=words.n_docs), every


@tidy
def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in word_slices(batch.column(1), lower=False):
            n, docs = words.counts().astype(float), words.n_docs
            length = (words.end - words.start).astype(float)
            held = np.bincount(words.doc, length, minlength=docs)
            out = {"n_words": n, "mean_word": held / np.maximum(n, 1)}
            for name, table in _CLASSES.items():
                total = np.concatenate([[0], np.cumsum(table[words.data])])
                each = total[words.end] - total[words.start]
                out[name] = np.bincount(words.doc, each, minlength=docs) / np.maximum(held, 1)
            out["distinct_share"] = np.bincount(distinct_by_doc(words.hash, words.doc)[1], minlength=docs) / np.maximum(n, 1)
            h, doc = words.shingles(5)
            runs = np.bincount(doc, minlength=docs)
            out["repeat_share"] = (runs - np.bincount(distinct_by_doc(h, doc)[1], minlength=docs)) / np.maximum(runs, 1)
            again, lines = _lines(words)
            out["line_repeat_share"] = again / np.maximum(lines, 1)
            out["words_per_line"] = n / np.maximum(lines, 1)
            out["long_share"] = np.bincount(words.doc, length > 20, minlength=docs) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(out[s].astype(float)) for s in STATISTICS)], ["doc_id", *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the STATISTICS as doubles) of each row; a null text counts as the empty one."""
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_statistics, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, True for above, bound)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, bound in self.terms:
            out &= (x[:, i] > bound) == above
        return out

    def column(self) -> Column:
        def term(i, above, bound):
            c = F.col(STATISTICS[i])
            return c > F.lit(bound) if above else c <= F.lit(bound)

        return reduce(lambda a, b: a & b, (term(*t) for t in self.terms))


@dataclass
class Model:
    bias: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """The score as one expression over the statistics."""
        logit = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            logit = logit + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _tree(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, value: np.ndarray) -> list[Rule]:
    """Grow one tree; adds its output to ``value``; returns every path to a node."""
    rules = []

    def grow(rows: np.ndarray, terms: tuple, depth: int) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best, where = 1e-6, None
        if depth < DEPTH and len(rows) >= 2 * LEAF:
            for i in range(codes.shape[1]):
                c = codes[rows, i]
                left_g = np.cumsum(np.bincount(c, gradient[rows], minlength=BINS))[:-1]
                left_h = np.cumsum(np.bincount(c, hessian[rows], minlength=BINS))[:-1]
                left_n = np.cumsum(np.bincount(c, minlength=BINS))[:-1]
                ok = (left_n >= LEAF) & (len(rows) - left_n >= LEAF)
                gain = np.where(ok, left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1), 0)
                k = int(gain.argmax())
                if gain[k] > best and k < len(cuts[i]):
                    best, where = gain[k], (i, k)
        if terms:
            rules.append(Rule(terms))
        if where is None:
            value[rows] += RATE * -g / (h + 1)
            return
        i, k = where
        low = codes[rows, i] <= k
        grow(rows[low], (*terms, (i, False, float(cuts[i][k]))), depth + 1)
        grow(rows[~low], (*terms, (i, True, float(cuts[i][k]))), depth + 1)

    grow(np.arange(len(codes)), (), 0)
    return rules


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost trees, take their paths as rules, and fit lasso weights."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 * LEAF or y.min() == y.max():
        return Model(base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T)], 1)
    value, found = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-value))
        for rule in _tree(codes, cuts, p - y, p * (1 - p), value):
            found.setdefault(rule, None)
    rules = [r for r in found]
    hits = np.stack([r.holds(x) for r in rules], 1)
    _, first = np.unique(hits, axis=1, return_index=True)  # rules that say the same count once
    keep = [i for i in sorted(first) if 0 < hits[:, i].mean() < 1]
    rules, z = [rules[i] for i in keep], hits[:, keep].astype(float)
    # proximal gradient with momentum on centred rules
    mean = z.mean(0)
    z -= mean
    step = 4.0 / max(1e-9, np.linalg.norm(z, 2) ** 2 / len(y))
    w, b, v, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), 1.0
    for _ in range(LASSO_STEPS):
        p = 1 / (1 + np.exp(-(z @ v + b)))
        b -= 2.0 * (p - y).mean()
        new = v - step * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (old - 1) / t * (new - w), new
    chosen = np.flatnonzero(w)
    return Model(float(b - mean[chosen] @ w[chosen]), [rules[i] for i in chosen], [float(w[i]) for i in chosen])


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled learning fold."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(~held_out() & F.col("quality").isNotNull())
    chosen = lowest_hashed(marked, sample)
    rows = stats.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *STATISTICS).toPandas().sort_values(["doc_id", "quality", *STATISTICS])
    return fit(rows[list(STATISTICS)].to_numpy(float), (rows["quality"].to_numpy(float) > 0).astype(float))


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    Learned from the labels outside the held-out fold; only the text is an input
    of a score. A null, empty or blank text has statistics of zero and is scored
    like any other. Repeated rows stay; without labels of both kinds every score
    is the share of label 1; an empty table gives an empty result.
    """
    stats = materialize(statistics(docs), "quality-statistics")
    model = learn(stats, labels)
    return stats.select("doc_id", held_out().alias("held_out"), model.column().alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
