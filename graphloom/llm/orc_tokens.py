"""Token ids in ORC: run-length encoded stripes, row indexes, Bloom filters.

Documents are dealt by range of doc_id, encoded, and written as one ORC file a
partition, so that file names and rows ascend with doc_id. ORC stores the ids
with its integer run-length encoding, keeps minima and maxima of doc_id for each
stripe and row group, and a Bloom filter on doc_id; a reader takes stripes in
parallel and skips those that can't hold the ids it looks for.

Encoding is that of the ``tokenizers`` library, the strings of special tokens
included. Where no pre-token holds white space, as in the vocabulary used here, a
chunk between ASCII white space is encoded once and remembered by its 64-bit hash,
within a cache of bounded bytes; each miss goes through the library. Probes tell whether a
vocabulary allows this; with any other, whole texts go through the library.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .scratch import fresh_path, materialize
from .textops import Words, word_slices
from .worker import holds, tidy

END_ID = 1
#: Bytes of chunks' hashes and ids that a Python worker remembers; it starts anew beyond that, with the next slice.
CACHE_BYTES = 64 << 20
#: Texts whose encoding tells whether chunks, and words by the model alone, give the ids of whole texts.
PROBES = ("the cat", "It's  2 on\tand\nu.s. naïve ÉTÉ", "straße x_y a-b 12345 it", "<|endoftext|> über\r\nÑandú, été!", " .a\x0bb\x0cc ")
ROW_GROUP = 1000
STRIPE_BYTES = 16 << 20

# Byte-level vocabularies show the bytes that don't print as the code points from 256 on.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINT))}

_encoders: dict[tuple[int, int], "_Chunks"] = {}


class _Chunks:
    """ids of white-space-free chunks, remembered by 64-bit hash in flat arrays.

    ``hash`` is sorted; the ids of its i-th chunk are ``size[i]`` numbers of
    ``flat`` from ``begin[i]``. ``flat`` begins with the end id. What doesn't fit
    into CACHE_BYTES is forgotten as a whole, and encoded anew where it is met again.
    """

    def __init__(self, vocabulary: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.end_id = end_id
        self.forget()
        words = [w for t in PROBES for w in t.encode().split()]
        #: Whether a text's ids are those of its chunks, and a plain word's those of the model by itself.
        self.by_chunk = all(self.library(t) == b"".join(map(self.library, t.encode().split())) for t in PROBES)
        self.by_model = self.by_chunk and all(self.library(w) == x for w in words if (x := self.word(w)) is not None)

    def forget(self) -> None:
        self.hash, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.array([self.end_id], np.int32)

    def nbytes(self) -> int:
        return self.hash.nbytes + self.begin.nbytes + self.size.nbytes + self.flat.nbytes

    def library(self, text: str | bytes) -> bytes:
        text = text.decode() if isinstance(text, bytes) else text
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, stem: bytes) -> bytes | None:
        """ids of one pre-token, whose only normalisation is to lower case: letters below U+0180."""
        letters = stem.decode()
        if not (letters.isalpha() and (stem.isascii() or (max(letters) < "\u0180" and "\u0130" not in letters))):
            return None
        shown = letters.lower() if stem.isascii() else letters.lower().encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def chunk(self, chunk: bytes, made: dict[bytes, bytes]) -> bytes:
        """ids of one chunk; ``made`` holds those of this slice's words."""
        out = made.get(chunk)
        if out is None:
            stem = chunk.rstrip(b".,!?;:") if self.by_model else chunk
            if self.by_model and 0 < len(stem) < len(chunk) and stem.decode().isalpha():
                return self.chunk(stem, made) + self.chunk(chunk[len(stem) :], made)  # the signs are a pre-token of their own
            out = self.word(chunk) if self.by_model else None
            out = made[chunk] = self.library(chunk) if out is None else out
        return out

    def lookup(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, begin, size): each word's index among the distinct chunks, and those chunks' places in ``flat``."""
        seen, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        if self.nbytes() > CACHE_BYTES:
            self.forget()
        at = np.searchsorted(self.hash, seen)
        known = np.zeros(len(seen), bool)
        known[at < len(self.hash)] = self.hash[at[at < len(self.hash)]] == seen[at < len(self.hash)]
        new = np.flatnonzero(~known)
        if len(new):
            raw, made = w.data.tobytes(), {}
            found = [self.chunk(raw[s:e], made) for s, e in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist())]
            size = np.fromiter(map(len, found), np.int32, len(found)) // 4
            begin = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), np.int32)])
            self.hash, self.begin, self.size = (np.insert(old, at[new], more) for old, more in ((self.hash, seen[new]), (self.begin, begin), (self.size, size)))
            at = np.searchsorted(self.hash, seen)
        return which, self.begin[at], self.size[at].astype(np.int64)


def _chunks_of(vocabulary: str, end_id: int) -> _Chunks:
    """The worker's cache for a vocabulary, kept from task to task."""
    holds("orc_tokens", _encoders.clear)
    key = (zlib.crc32(vocabulary.encode()), end_id)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = _Chunks(vocabulary, end_id)
    return _encoders[key]


def _encode(vocabulary, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, row = _chunks_of(vocabulary.value, end_id), 0
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for a, b, w in word_slices(batch.column(1), lower=False):
                if chunks.by_chunk:
                    # A slice's distinct chunks are looked up once each, and laid out by index.
                    which, begin, size = chunks.lookup(w)
                    begin, size, flat = np.append(begin, 0), np.append(size, 1), chunks.flat
                    which = np.insert(which, w.first[1:], len(begin) - 1)  # each document's end
                    words_upto = w.first + np.arange(w.n_docs + 1)
                else:
                    found = [chunks.library(t or "") + end for t in batch.column(1).slice(a, b - a).to_pylist()]
                    which, words_upto = np.arange(len(found)), np.arange(len(found) + 1)
                    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
                    begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(found), np.int32)
                count = size[which]
                upto = np.concatenate([[0], np.cumsum(count)])
                ids = flat[np.repeat(begin[which] - upto[:-1], count) + np.arange(upto[-1])]
                lists = pa.ListArray.from_arrays(pa.array(upto[words_upto], pa.int32()), pa.array(ids))
                rows = pa.array(np.arange(row, row + b - a))
                row += b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), rows, lists], ["doc_id", "row", "ids"])

    return tidy(run)


_FILE = "doc_id long, row long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC under ``path`` in ascending doc_id order.

    A null or empty text is its end id alone. Rows of one doc_id follow one
    another in the order of their texts; null doc_ids come first. row is a row's
    place in its file. Other columns are ignored; an empty table writes files
    without rows.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text())
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_encode(vocabulary, end_id), _FILE)
        .write.option("compression", "none")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of all documents, or of a few: then stripes are pruned."""
    out = spark.read.schema(_FILE).orc(path).select("doc_id", "ids")
    return out if doc_ids is None else out.filter(F.col("doc_id").isin(*doc_ids))


@tidy
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        ends = np.asarray(ids.offsets)
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(3)],
            ["doc_id", "row", "n_tokens", "ids_crc32", "file"],
        )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files; start follows the rows' places."""
    rows = (
        spark.read.schema(_FILE).orc(path)
        .select("doc_id", "row", "ids", F.col("_metadata.file_name").alias("file"))
        .mapInArrow(_digest, "doc_id long, row long, n_tokens long, ids_crc32 long, file string")
    )
    rows = materialize(rows, "token-index")
    # One row a file; files hold disjoint ranges of doc_id.
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("least"))
    before = Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "file").select(
        "doc_id", (F.col("offset") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_to_orc(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the token files and return their index."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens-orc")
    write_tokens(docs, path, vocabulary_path, end_id)
    return token_index(spark, path)
