"""Language ID by unigram pieces, marginalised over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary (and
single bytes, so that every text has a segmentation). A word's probability is
the sum over all its segmentations, by a forward algorithm; a text's is the
product over its words. A word counts with a share of noise that all languages
have in common, so one odd word can't decide. Probabilities come from expectation maximisation on a
bounded sample of labelled texts. Words are scored once and remembered within
a bound, so the cost follows the distinct words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .folds import held_out, lowest_hashed
from .scratch import unused
from .textops import Words, text_buffers, word_slices
from .worker import holds, tidy

#: Labelled documents of each language that are learned from, whole texts.
SAMPLE = 300
#: Languages that are learned, the most frequent first.
MAX_LANGUAGES = 64
ROUNDS = 3
#: Longest piece, and longest run of a word that is scored as one, in bytes.
LONGEST, SPAN = 12, 32
FLOOR = 1e-7
#: Pseudo-uses of each piece, and the share of words that are noise.
PSEUDO, NOISE = 0.5, 0.02
#: Words that a Python worker remembers; it starts anew beyond that.
CACHE = 600_000
MARK = 32  # the byte before a word's first one
UNDETERMINED = "und"


def vocabulary(model_path: str) -> list[bytes]:
    """The pieces of a sentencepiece model as bytes, with MARK for a word's beginning."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {
        m.id_to_piece(i).replace("▁", chr(MARK)).encode()
        for i in range(m.get_piece_size())
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))
    }
    return sorted(p for p in pieces if 1 < len(p) <= LONGEST and MARK not in p[1:])


@dataclass
class Trie:
    """Transitions between prefixes of pieces; node 0 is dead, 1 the root."""

    pieces: list[bytes]
    step: np.ndarray  # node, byte -> node
    piece: np.ndarray  # node -> piece or -1

    @classmethod
    def of(cls, pieces: list[bytes]) -> Trie:
        pieces = [bytes([b]) for b in range(256)] + [p for p in pieces if len(p) > 1]
        nodes: list[dict[int, int]] = [{}, {}]
        ends: dict[int, int] = {}
        for k, p in enumerate(pieces):
            at = 1
            for b in p:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                at = nodes[at][b]
            ends[at] = k
        step = np.zeros((len(nodes), 256), np.int32)
        for i, d in enumerate(nodes):
            for b, j in d.items():
                step[i, b] = j
        piece = np.full(len(nodes), -1, np.int32)
        piece[list(ends)] = list(ends.values())
        return cls(pieces, step, piece)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes padded to a matrix, length, word) of words with their mark; long words in runs of SPAN bytes."""
    n = end - start + 1
    runs = -(-n // SPAN)
    word = np.repeat(np.arange(len(n)), runs)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(runs) - runs, runs)
    size = np.minimum(SPAN, n[word] - nth * SPAN)
    at = (start[word] - 1 + nth * SPAN)[:, None] + np.arange(int(size.max(initial=0)))
    out = data[np.clip(at, 0, len(data) - 1)]
    out[nth == 0, :1] = MARK
    return out, size, word


def matches(trie: Trie, text: np.ndarray, size: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, pieces) of all places of all pieces, by place."""
    found = []
    for j in range(text.shape[1]):
        rows = np.flatnonzero(size > j)
        node = np.ones(len(rows), np.int32)
        for k in range(j, min(text.shape[1], j + LONGEST)):
            if k > j:
                far = size[rows] > k
                rows, node = rows[far], node[far]
            node = trie.step[node, text[rows, k]]
            live = node > 0
            rows, node = rows[live], node[live]
            if not len(rows):
                break
            piece = trie.piece[node]
            ends = piece >= 0
            if ends.any():
                found.append((j, k + 1, rows[ends], piece[ends]))
    return found


def forward(found: list, n: int, width: int, p: np.ndarray) -> np.ndarray:
    """Sums over segmentations of each prefix: [place, row, language]."""
    a = np.zeros((width + 1, n, p.shape[1]))
    a[0] = 1
    for j, k, rows, piece in found:
        a[k, rows] += a[j, rows] * p[piece]
    return a


def _expected(found: list, size: np.ndarray, weight: np.ndarray, p: np.ndarray, width: int) -> np.ndarray:
    """Expected uses of each piece, for one language."""
    n = len(size)
    a = forward(found, n, width, p[:, None])[:, :, 0]
    b = np.zeros((width + 1, n))
    b[size, np.arange(n)] = 1
    for j, k, rows, piece in reversed(found):
        b[j, rows] += p[piece] * b[k, rows]
    total, out = a[size, np.arange(n)], np.zeros(len(p))
    for j, k, rows, piece in found:
        out += np.bincount(piece, a[j, rows] * p[piece] * b[k, rows] / total[rows] * weight[rows], minlength=len(p))
    return out


@dataclass
class Model:
    languages: list[str]
    trie: Trie
    p: np.ndarray  # piece, language

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log probability of each word under each language."""
        out = np.zeros((len(start), len(self.languages)))
        length = end - start
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), 16384):  # words of like length together
            some = order[at : at + 16384]
            text, size, word = spans(data, start[some], end[some])
            a = forward(matches(self.trie, text, size), len(size), text.shape[1], self.p)
            log = np.log(a[size, np.arange(len(size))])
            for c in range(log.shape[1]):
                out[some, c] = np.bincount(word, log[:, c], minlength=len(some))
        if out.shape[1]:
            top = out.max(1, keepdims=True)
            out = top + np.log((1 - NOISE) * np.exp(out - top) + NOISE * np.exp(out - top).mean(1, keepdims=True))
        return out


def fit(texts: dict[str, list[str]], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Learn each language's piece probabilities from whole texts."""
    languages = sorted(texts)
    sets = []
    for name in languages:
        data, offsets = text_buffers(pa.array(texts[name], pa.large_string()))
        w = Words(data, offsets)
        _, first, count = np.unique(w.hash, return_index=True, return_counts=True)
        order = np.argsort((w.end - w.start)[first], kind="stable")
        first, count = first[order], count[order]
        sets.append([(*spans(w.data, w.start[i], w.end[i]), c) for i, c in ((first[k : k + 16384], count[k : k + 16384]) for k in range(0, len(first), 16384))])
    trie = Trie.of(pieces)
    p = np.full((len(trie.pieces), len(languages)), 1.0)
    p /= p.sum(0)
    for turn in range(rounds):
        used = np.zeros_like(p)
        for c, parts in enumerate(sets):
            for text, size, word, count in parts:
                used[:, c] += _expected(matches(trie, text, size), size, count[word].astype(float), p[:, c], text.shape[1])
        if turn == 0:  # pieces that no language uses only make the trie larger
            some = (used.max(1) >= 1) | (np.arange(len(used)) < 256)
            used = used[some]
            trie = Trie.of([q for q, s in zip(trie.pieces, some) if s])
        p = used + PSEUDO
        p = np.maximum(p / p.sum(0), FLOOR)
    return Model(languages, trie, p)


def training_texts(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """Up to ``sample`` whole texts of each of the most frequent languages of the learning fold."""
    spark = docs.sparkSession
    base = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    names = [r.lang for r in base.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    ids = [(r.doc_id, r.lang) for x in names for r in lowest_hashed(base.filter(F.col("lang") == x).select("doc_id", "lang"), sample).collect()]
    if not ids:
        return {}
    chosen = spark.createDataFrame(ids, "doc_id long, lang string").distinct()
    out: dict[str, list[str]] = {}
    rows = base.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").collect()
    for r in sorted(rows):
        out.setdefault(r.lang, []).append(r.text)
    return out


_state: dict = {}


def _known(key: int, languages: int) -> dict:
    """The worker's cache of words' scores under a model, kept from task to task."""
    holds("language_id", _state.clear)
    if _state.get("key") != key:
        _state.update(key=key, hash=np.zeros(0, np.uint64), log=np.zeros((0, languages), np.float32))
    return _state


def _predict(model, key: int, with_text: bool = False, names: Sequence[str] = ("lang_pred", "score")):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        state = _known(key, len(m.languages))
        labels = pa.array([*m.languages, UNDETERMINED])
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            kept = [i for i, name in enumerate(batch.schema.names) if name != "text" or with_text]
            for a, b, w in word_slices(texts):
                seen, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
                known, log = state["hash"], state["log"]
                at = np.minimum(np.searchsorted(known, seen), max(0, len(known) - 1))
                new = np.flatnonzero(known[at] != seen) if len(known) else np.arange(len(seen))
                if len(new):
                    if len(known) + len(new) > CACHE:
                        known, log, new = known[:0], log[:0], np.arange(len(seen))
                    fresh = m.words(w.data, w.start[first[new]], w.end[first[new]]).astype(np.float32)
                    known, log = np.concatenate([known, seen[new]]), np.concatenate([log, fresh])
                    order = np.argsort(known, kind="stable")
                    state["hash"], state["log"] = known, log = known[order], log[order]
                each = log[np.searchsorted(known, seen)][back]
                total = np.stack([np.bincount(w.doc, each[:, c].astype(float), minlength=w.n_docs) for c in range(each.shape[1])], 1)
                best = total.argmax(1)
                score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i in range(b - a):
                    t = texts[a + i].as_py()
                    if t is None or not any(map(str.isalpha, t)):
                        best[i], score[i] = len(m.languages), 0.0
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in kept), labels.take(pa.array(best)), pa.array(score)],
                    [*(batch.schema.names[i] for i in kept), *names],
                )

    return tidy(run)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of (doc_id, text); score is the posterior of lang_pred.

    A text that is null or has no letter is ``und`` with score 0; of languages
    with equal scores the first by name is given. Only the text is looked at.
    Repeated rows stay; an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not model.languages:
        return base.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    key = zlib.crc32(model.p.tobytes())
    return base.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), key), "doc_id long, lang_pred string, score double")


def _learn(docs: DataFrame, model_path: str) -> Model:
    texts = training_texts(docs)
    return fit(texts, vocabulary(model_path)) if texts else Model([], Trie.of([]), np.zeros((256, 0)))


def identify(docs: DataFrame, model_path: str) -> DataFrame:
    """Learn from the labelled fold of ``docs``, then predict every row."""
    return predict(docs, _learn(docs, model_path)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model_path: str) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns and no shuffle."""
    model = _learn(docs, model_path)
    if not model.languages:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    names = [unused(docs, "lang_pred"), unused(docs, "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{names[0]}` string, `{names[1]}` double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.mapInArrow(_predict(shared, zlib.crc32(model.p.tobytes()), with_text=True, names=names), schema)
    return rows.filter(F.col(names[0]) != UNDETERMINED).drop(*names)
