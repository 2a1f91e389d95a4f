"""Bloom filters of fixed size over 64-bit ids: they spare work and never decide a result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textops import U64, mix

#: log2 of a filter's bits: 1 MB at any input size.
BLOOM_LOG2 = 23


def _bits(ids: np.ndarray) -> np.ndarray:
    """The filter's three bits of each id."""
    return np.stack([mix(ids.view(U64) + U64(0x9E37 * (i + 1))) & U64((1 << BLOOM_LOG2) - 1) for i in range(3)])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.unique(_bits(np.unique(batch.column(0).to_numpy())).ravel())
        word, mask = (bits >> U64(6)).astype(np.int32), U64(1) << (bits & U64(63))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["w", "m"])


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """A filter of a one-column table of longs, without nulls, as 64-bit words."""
    rows = ids.mapInArrow(_parts, "w int, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (BLOOM_LOG2 - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return out.view(U64)


def may_hold(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bits = _bits(ids)
    return ((words[(bits >> U64(6)).astype(np.int64)] >> (bits & U64(63))) & U64(1)).all(0)
