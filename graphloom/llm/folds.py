"""The fold rule of the labelled queries, and bounded samples for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def lowest_hashed(ids: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """The ``n`` rows of (doc_id, ...) with the least hash: a sample that reruns repeat."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
