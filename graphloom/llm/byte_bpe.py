"""Byte-level BPE by overlapping chunks, and its decoding.

A long text is cut into chunks that overlap; the chunks are rows of their own,
so one document's text is pre-tokenised by many tasks at once. A chunk's first
boundaries are a guess, since it starts anywhere. Pre-tokenisation from a
position depends on what follows alone, so where two neighbours share a boundary
they agree from there on: the document is stitched at such places, each piece
between two boundaries is encoded by its ranks, and where chunks share no
boundary (a piece longer than the overlap) both are pre-tokenised together.
Texts of one chunk skip the stitching. Decoding concatenates the bytes of ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .worker import holds, tidy

#: Code points of a chunk, and of what it shares with the next one.
CHUNK, OVERLAP = 16_384, 512
#: Pieces that a Python worker remembers; it starts anew beyond that.
CACHE = 100_000

_coders: dict[tuple, "_Coder"] = {}


class _Coder:
    def __init__(self, ranks_text: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_text.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def spans(self, text: str) -> list[int]:
        """Starts of the pre-tokens, and the end of the last one."""
        found = [m.span() for m in self.pattern.finditer(text)]
        return [a for a, _ in found] + ([found[-1][1]] if found else [0])

    def piece(self, piece: str) -> bytes:
        out = self.known.get(piece)
        if out is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            out = self.known[piece] = self.ids(piece)
        return out


def _coder(ranks, pattern: str) -> _Coder:
    holds("byte_bpe", _coders.clear)
    key = (hashlib.sha256(ranks.value).digest(), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = _Coder(ranks.value, pattern)
    return _coders[key]


def _bytes_of_ids(ranks) -> list[bytes]:
    """The raw bytes of each id: all that decoding needs."""
    found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, ranks.value.splitlines())}
    return [found.get(i, b"") for i in range(max(found, default=-1) + 1)]


def stitch(coder: _Coder, chunks: list[tuple[int, str, list[int]]]) -> list[str]:
    """The document's pieces, from its chunks: start, text (with the overlap), boundaries within the text."""
    pieces: list[str] = []
    start, text, bounds = chunks[0]
    true_from = start  # a true boundary, from which ``bounds`` hold
    for next_start, next_text, next_bounds in chunks[1:]:
        # The last piece may go on beyond the window, so its end doesn't count.
        mine = {start + b for b in bounds[:-1] if start + b >= max(next_start, true_from)}
        meet = min((next_start + b for b in next_bounds[:-1] if next_start + b in mine), default=None)
        if meet is None:  # pre-tokenise both as one
            text = text[true_from - start :] + next_text[start + len(text) - next_start :]
            start = true_from
            bounds = coder.spans(text)
            continue
        here = [b for b in bounds if true_from <= start + b <= meet]
        pieces += [text[a:b] for a, b in zip(here[:-1], here[1:])]
        start, text, bounds, true_from = next_start, next_text, next_bounds, meet
    here = [b for b in bounds if start + b >= true_from]
    return pieces + [text[a:b] for a, b in zip(here[:-1], here[1:])]


def _forget() -> None:
    """Encoder and decoder run in two workers of a task: between tasks neither keeps its tables."""
    _coders.clear()


def _short(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < len(texts):
                out, size, a = [], 0, at
                while at < len(texts) and size < 16 << 20:
                    out.append(coder.ids(texts[at].as_py() or ""))
                    size += len(out[-1])
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, at - a), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return tidy(run, _forget)


def _boundaries(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            bounds = [np.array(coder.spans(t), "<i4").tobytes() for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds, pa.binary())], ["row", "start", "doc_id", "times", "piece", "bounds"])

    return tidy(run, _forget)


def _join_chunks(ranks, pattern: str):
    """Streams chunks in order of (row, start); holds one document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)

        def done(doc_id, times, chunks):
            ids = b"".join(map(coder.piece, stitch(coder, chunks)))
            return pa.RecordBatch.from_arrays([pa.array([doc_id] * times, pa.int64()), pa.array([ids] * times, pa.binary())], ["doc_id", "ids"])

        open_row, doc, chunks = None, (None, 0), []
        for batch in batches:
            for r, s, d, times, t, b in zip(*(c.to_pylist() for c in batch.columns)):
                if r != open_row and chunks:
                    yield done(*doc, chunks)
                    chunks = []
                open_row, doc = r, (d, times)
                chunks.append((s, t, np.frombuffer(b, "<i4").tolist()))
        if chunks:
            yield done(*doc, chunks)

    return tidy(run, _forget)


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) with ids as bytes of little-endian unsigned 32-bit integers.

    A null text is the empty one, and has no id. Repeated rows stay repeated;
    other columns are ignored; an empty table gives an empty result.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.char_length("text")
    short = base.filter(n <= chunk).mapInArrow(_short(ranks, pattern), "doc_id long, ids binary")
    long = base.filter(n > chunk).select(
        F.xxhash64("doc_id", "text").alias("row"), "doc_id", F.explode(F.sequence(F.lit(0), n - 1, F.lit(chunk))).alias("start"), "text"
    )
    # Chunks spread over the tasks; those of repeated rows are equal, and count as one with ``times``.
    pieces = (
        long.select("row", "doc_id", "start", F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("piece"))
        .groupBy("row", "start").agg(F.first("doc_id").alias("doc_id"), F.count("*").cast("int").alias("times"), F.first("piece").alias("piece"))
        .mapInArrow(_boundaries(ranks, pattern), "row long, start int, doc_id long, times int, piece string, bounds binary")
    )
    joined = pieces.repartition("row").sortWithinPartitions("row", "start").mapInArrow(_join_chunks(ranks, pattern), "doc_id long, ids binary")
    return short.unionByName(joined)


def _decoded(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of_ids(ranks)
        for batch in batches:
            n, sha, back = [], [], []
            for x in batch.column(1):
                raw = x.as_buffer()
                ids = np.frombuffer(raw, "<u4").tolist()
                n.append(len(ids))
                sha.append(hashlib.sha256(raw).hexdigest())
                back.append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return tidy(run)


def _texts(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bytes_of_ids(ranks)
        for batch in batches:
            out = [b"".join(map(table.__getitem__, np.frombuffer(x.as_buffer(), "<u4").tolist())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return tidy(run)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): the concatenated raw bytes of the ids."""
    ranks = encoded.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    return encoded.select("doc_id", "ids").mapInArrow(_texts(ranks), "doc_id long, bytes binary")


def digest(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents."""
    ranks = encoded.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
