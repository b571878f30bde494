"""Scoring inside groups: stored vectors and the queries that ask them meet on a key, and only the best k of a group leave a task.

Rows are (cell, block, asks, id, v): stored vectors have asks = 0, queries 1. A group's stored vectors are held by one task, so their number
is bounded by whoever makes the groups; queries stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Scores that a task holds at once, about: 32 MB, and twice that for their order.
SCORE_ROOM = 4_000_000


def matrix(col: pa.Array, rows: int) -> np.ndarray:
    """The vectors of a list column as doubles; all have one length."""
    return col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 1))


def best_of(qids: np.ndarray, q: np.ndarray, ordinals: np.ndarray, x: np.ndarray, norms: np.ndarray | None, k: int) -> pa.RecordBatch:
    """(qid, ordinal, score): the best k of x for each row of q; NaN last, ties by ordinal. x is in order of ordinals."""
    scores = q @ x.T
    if norms is not None:
        with np.errstate(all="ignore"):
            scores /= norms
    key = np.where(np.isnan(scores), np.inf, -scores)
    n = min(k, len(ordinals))
    if n < len(ordinals):
        # all that tie with the k-th are candidates, and the smaller ordinals of them win
        kth = np.partition(key, n - 1, axis=1)[:, n - 1 : n]
        row, col = np.nonzero(key <= kth)
        order = np.lexsort((col, key[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[rank < n], col[rank < n]
    else:
        row, col = (a.reshape(-1) for a in np.indices(key.shape))
    return pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ordinals[col]), pa.array(scores[row, col])], ["qid", "ordinal", "score"])


def group_scores(rows: DataFrame, k: int, *, normalized: bool = False) -> DataFrame:
    """(qid, ordinal, score): for each group and each query in it the best k of its stored vectors. Queries have length 1; `normalized` says that stored vectors have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, cell = None, [], None

        def close():
            ids = np.concatenate([p.column("id").to_numpy() for p in parts])
            x = np.concatenate([matrix(p.column("v"), p.num_rows) for p in parts])
            order = np.argsort(ids, kind="stable")
            return ids[order], x[order], None if normalized else np.linalg.norm(x[order], axis=1)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("cell", "block", "asks")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                key, asks, part = (keys[0][lo], keys[1][lo]), keys[2][lo], batch.slice(lo, hi - lo)
                if key != group:
                    group, parts, cell = key, [], None
                if not asks:
                    parts.append(part)
                    continue
                if cell is None and parts:
                    cell, parts = close(), []
                if cell is not None:
                    ids, q = part.column("id").to_numpy(), matrix(part.column("v"), part.num_rows)
                    step = max(1, SCORE_ROOM // len(cell[0]))
                    for at in range(0, len(ids), step):
                        yield best_of(ids[at : at + step], q[at : at + step], *cell, k)

    grouped = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")
    return grouped.mapInArrow(run, "qid long, ordinal long, score double")
