"""Vectorised word and shingle hashing over Arrow batches of text.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased on
request. Everything works on the flat UTF-8 buffer of a slice of documents, so
there is no Python loop over words. Hashes are 64-bit, the same in every
process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.RandomState(20240607)
_BYTE = _RNG.randint(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_POW = (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = (_RNG.randint(0, 2**62, 16, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything but ASCII letters, digits and bytes of longer code points.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are hashed at once.
SLICE_BYTES = 2 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        if size > SLICE_BYTES:  # a very long text: its tables aren't kept
            return _raise(size)
        _powers[size] = _raise(size)
    return _powers[size]


def _raise(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in _POW:
        a = np.full(size, base, U64)
        a[0] = U64(1)
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(a))
    return out[0], out[1]


class Words:
    """The words of a slice of documents: hash, byte range and document of each."""

    __slots__ = ("_down", "_total", "data", "doc", "end", "first", "hash", "n_docs", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, between: np.ndarray = _SPACE):
        self.n_docs = len(offsets) - 1
        base, stop = int(offsets[0]), int(offsets[-1])
        data = data[base:stop]
        if lower:
            data = _LOWER[data]
        offsets = offsets - base
        n = len(data)
        self.data = data
        solid = ~between[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | cut[:-1]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | cut[1:])) + 1
        if n:
            up, down = _power_tables(n)
            total = np.empty(n + 1, U64)
            total[0] = 0
            np.cumsum(_BYTE[data] * up[:n], out=total[1:])
            self._total, self._down = total, down
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))
        else:
            self._total, self._down, self.hash = np.zeros(1, U64), np.zeros(0, U64), np.zeros(0, U64)
        #: Index of each document's first word, and one past the last document's.
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of the first ``length`` bytes of each longer word."""
        long = self.end - self.start > length
        a, doc = self.start[long], self.doc[long]
        return mix((self._total[a + length] - self._total[a]) * self._down[a] + U64(length) * _PLACE[14]), doc

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of each run of ``k`` words, in text order.

        A document of 1 to k-1 words has its whole sequence as its one shingle.
        """
        n = len(self.hash)
        m = max(0, n - k + 1)
        h = np.zeros(m, U64)
        for j in range(k):
            h += self.hash[j : j + m] * _PLACE[j]
        keep = self.doc[:m] == self.doc[k - 1 :] if m else np.zeros(0, bool)
        h, doc = h[keep], self.doc[:m][keep]
        count = self.counts()
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.zeros(len(short), U64)
            for j in range(k - 1):
                has = count[short] > j
                extra[has] += self.hash[self.first[short[has]] + j] * _PLACE[j]
            extra += count[short].astype(U64) * _PLACE[15]
            h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            h, doc = h[order], doc[order]
        return mix(h), doc


def distinct_by_doc(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes, sorted within the document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer one stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_slices(column: pa.Array, lower: bool = True, limit: int = SLICE_BYTES, between: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first document, end, its words) over a text column; ``between`` says which bytes part words."""
    data, offsets = text_buffers(column)
    for a, b in slices(offsets, limit):
        yield a, b, Words(data, offsets[a : b + 1], lower, between)
