"""Shared pieces of the training-data operators: materialised tables, checked broadcasts, tokenising helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, materialize, release, work_dir

__all__ = ["BROADCAST_ROWS", "WORD", "WordHasher", "checked_semi", "column", "discard", "list_array", "materialize", "mix64", "release", "sub_batches", "windows_of", "work_dir"]

#: A maximal run of letters and digits (categories L and N): what str.isalnum() accepts, without the underscore.
WORD = re.compile(r"[^\W_]+")

#: Rows that a semi-join may broadcast: 16 bytes each, so 16 MB at most; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def checked_semi(df: DataFrame, keys: DataFrame, on: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df left-semi keys: broadcast if keys has at most `bound` rows (counted), else a shuffled join.

    keys must be cheap to read twice, such as a materialised table.
    """
    small = keys.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHasher:
    """64-bit hashes of words, remembered up to a bounded number of entries."""

    def __init__(self, bound: int = 400_000):
        self.known: dict[str, int] = {}
        self.bound = bound

    def __call__(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > self.bound:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def windows_of(hashes: np.ndarray, lengths: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(record index, window hash) of every run of `words` consecutive words that stays inside its record."""
    if len(hashes) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    last = len(hashes) - words + 1
    h = hashes[:last].copy()
    for j in range(1, words):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + last]
    keep = owner[:last] == owner[words - 1 :]
    return owner[:last][keep], mix64(h[keep])


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def sub_batches(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a bounded number, so that long texts don't pile up in a worker."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def column(df: DataFrame, name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
