"""Approximate search by inverted cells, in place of a sequentially built graph index.

Codebooks are fitted on a bounded sample: one of up to ROUTES centroids, for more cells a second one of what the first leaves, and
so on; a cell is a combination of one centroid of each. Cells hold about CELL vectors at every size of the table. A query is scored
exactly against the vectors of its nearest cells, inside groups of one cell. How many cells it asks follows from a recall
measured against the exact search on a bounded sample of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..tables import materialize
from .cells import group_scores, matrix
from .search import exact_search, top_k

#: Vectors of an average cell, the most centroids of one codebook, and sampled vectors for each of them.
CELL, ROUTES, SAMPLED = 100, 1024, 40
#: A cell of more vectors is scored in blocks of about this many.
BLOCK = 8192
#: Recall that the asked cells must reach on the sampled queries, and how many are sampled at most.
RECALL, SAMPLE = 0.95, 256
#: Asked cells that a semi-join may broadcast: 8 bytes each.
BROADCAST_CELLS = 1_000_000


@dataclass
class Codebooks:
    books: list[np.ndarray]

    @property
    def cells(self) -> int:
        return prod(map(len, self.books))

    def nearest(self, x: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, distances), the best n of each row in order. Of several codebooks the best `width` combinations go on to the next one."""
        cells, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        rest = x[:, None, :]  # what is left of x after the codes so far
        for i, book in enumerate(self.books):
            step = (book**2).sum(1) - 2 * (rest @ book.T)
            total = (cost[:, :, None] + step).reshape(len(x), -1)
            keep = min(n if i == len(self.books) - 1 else width, total.shape[1])
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.broadcast_to(np.arange(keep), (len(x), keep))
            cost = np.take_along_axis(total, best, 1)
            order = np.lexsort((best, cost), axis=1)
            best, cost = np.take_along_axis(best, order, 1), np.take_along_axis(cost, order, 1)
            parent, code = best // len(book), best % len(book)
            cells = np.take_along_axis(cells, parent, 1) * len(book) + code
            if i < len(self.books) - 1:
                rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[code]
        return cells, cost

    def rows(self) -> list[tuple[int, int, list[float]]]:
        return [(level, code, [float(v) for v in c]) for level, book in enumerate(self.books) for code, c in enumerate(book)]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    centers = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        half = (centers**2).sum(1) / 2
        near = np.concatenate([(x[i : i + 4096] @ centers.T - half).argmax(1) for i in range(0, len(x), 4096)])
        order, n = np.argsort(near, kind="stable"), np.bincount(near, minlength=k)
        starts = np.flatnonzero(np.r_[True, np.diff(near[order]) != 0])
        sums = np.zeros_like(centers)
        sums[near[order][starts]] = np.add.reduceat(x[order], starts)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centers


def ivf_build(vectors: DataFrame, *, cells: int | None = None, seed: int = 42, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(codebooks(level, code, centroid), stored(cell, ordinal, embedding)). `cells` defaults to one for each CELL vectors.

    Vectors that are null, of another length than most of the sample, or not finite have no cell. The codebooks are fitted when it is
    called, on at most SAMPLED * ROUTES vectors drawn by a hash of their ordinals.
    """
    spark = vectors.sparkSession
    unit = vectors.where("embedding is not null").select("ordinal", l2_normalize("embedding").cast("array<float>").alias("v"))
    n = unit.count()
    left, sizes = max(1, cells or n // CELL), []
    while left > 1 or not sizes:
        sizes.append(min(left, ROUTES))
        left = -(-left // ROUTES)
    room = SAMPLED * max(sizes)
    share = F.pmod(F.xxhash64("ordinal", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 1.2 * room / max(n, 1)) * (1 << 30))
    drawn = unit.where(share).orderBy(F.xxhash64("ordinal", F.lit(seed)), "ordinal").limit(room).select("v").toArrow().column("v").combine_chunks()
    lengths = drawn.value_lengths().to_numpy(zero_copy_only=False).astype(int) if len(drawn) else np.zeros(0, int)
    dim = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    x = matrix(drawn.filter(pa.array(lengths == dim)), int((lengths == dim).sum())) if dim else np.zeros((0, 1))
    x = x[np.isfinite(x).all(1)]
    books, rng = [], np.random.default_rng(seed)
    for size in sizes:
        if not len(x):
            break
        books.append(_kmeans(x, min(size, len(x)), rng, rounds))
        x = x - books[-1][np.concatenate([((books[-1] ** 2).sum(1) / 2 - x[i : i + 4096] @ books[-1].T).argmin(1) for i in range(0, len(x), 4096)])]
    index = Codebooks(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                b = b.filter(pa.array(b.column("v").value_lengths().to_numpy(zero_copy_only=False) == dim))
                v = matrix(b.column("v"), b.num_rows)
                ok = np.flatnonzero(np.isfinite(v).all(1)) if b.num_rows else ()
                if len(ok) and books:
                    b = b.take(pa.array(ok))
                    yield pa.RecordBatch.from_arrays([pa.array(index.nearest(v[ok], 1, 8)[0][:, 0]), b.column("ordinal"), b.column("embedding")], ["cell", "ordinal", "embedding"])

    rows = vectors.where("embedding is not null").select(F.col("ordinal").cast("long").alias("ordinal"), l2_normalize("embedding").cast("array<float>").alias("v"), F.col("embedding").cast("array<float>").alias("embedding"))
    stored = rows.mapInArrow(assign, "cell long, ordinal long, embedding array<float>")
    return spark.createDataFrame(index.rows(), "level int, code int, centroid array<double>"), stored


def codebooks(table: DataFrame) -> Codebooks:
    """From the table: at most ROUTES rows a level, and few levels."""
    rows = sorted((r.level, r.code, r.centroid) for r in table.collect())
    return Codebooks([np.array([c for at, _, c in rows if at == level]) for level in sorted({r[0] for r in rows})])


@dataclass(frozen=True)
class Probes:
    """Cells that a query asks, and combinations that the search over several codebooks keeps."""

    cells: int
    width: int


def ivf_probes(vectors: DataFrame, index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, *, recall: float = RECALL, sample: int = SAMPLE, own: bool = False) -> Probes:
    """The fewest cells that hold `recall` of the exact best k of the sampled queries, drawn by a hash of their ids.

    `own` says that a qid is the ordinal of the same vector, which then doesn't count as a neighbour of itself.
    """
    books = codebooks(index[0])
    drawn = queries.select("qid", "query").orderBy(F.xxhash64("qid"), "qid").limit(sample)
    truth = exact_search(index[1].select("ordinal", "embedding"), drawn, k + own).where(F.col("ordinal") != F.col("qid") if own else F.lit(True)).select("qid", "ordinal")
    where = truth.join(index[1].select("ordinal", "cell"), "ordinal").select("qid", "cell").collect()  # at most sample * k rows
    if not where or books.cells == 1:
        return Probes(1, 1)
    holding: dict[int, list[int]] = {}
    for qid, cell in where:
        holding.setdefault(qid, []).append(cell)
    q = {r[0]: r[1] for r in drawn.select("qid", l2_normalize("query")).collect() if r[0] in holding}
    width = 8
    while True:
        places = []
        for qid, v in q.items():
            cells = books.nearest(np.array([v]), books.cells, width)[0][0]
            place = {c: i for i, c in enumerate(cells.tolist())}
            places += [place.get(c, books.cells) for c in holding[qid]]
        need = int(np.sort(places)[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)])
        if need < books.cells or len(books.books) == 1 or width >= prod(map(len, books.books[:-1])):
            return Probes(min(need + 1, books.cells), width)
        width *= 4


def asked_cells(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, *, ef: int, probes: Probes) -> DataFrame:
    """(cell, id, v): the cells that each query asks, with the query scaled to length 1. At least as many as hold max(ef, k) vectors on average."""
    books = codebooks(index[0])
    n = min(max(probes.cells, -(-max(ef, k) // CELL) + 1), books.cells)
    shared = queries.sparkSession.sparkContext.broadcast(books)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                cells = b.nearest(matrix(part.column("v"), part.num_rows), n, max(probes.width, n))[0]
                row, col = (x.reshape(-1) for x in np.indices(cells.shape))
                few = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cells[row, col]), part.column("id").take(few), part.column("v").take(few)], ["cell", "id", "v"])

    unit = queries.select(F.col("qid").cast("long").alias("id"), l2_normalize("query").cast("array<double>").alias("v")).where(f"size(v) = {books.books[0].shape[1]}")
    return materialize(unit.mapInArrow(route, "cell long, id long, v array<double>"), "asked-cells")


def ann_search(vectors: DataFrame, index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, *, ef: int = 0, probes: Probes | None = None) -> DataFrame:
    """(qid, rank, ordinal, score): the best k among the vectors of the asked cells, by exact cosines. Without `probes` they are measured on these queries.

    Only cells that some query asks are shuffled; a query goes to its cells, not to their members. Jobs run when it is called.
    """
    if not codebooks(index[0]).books:
        return vectors.sparkSession.createDataFrame([], "qid long, rank int, ordinal long, score double")
    asked = asked_cells(index, queries, k, ef=ef, probes=probes or ivf_probes(vectors, index, queries, k))
    wanted = materialize(asked.select("cell").distinct(), "wanted-cells")
    small = wanted.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    stored = index[1].join(F.broadcast(wanted) if small else wanted, "cell", "left_semi")
    hot = stored.groupBy("cell").count().where(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("cut"))
    hot = materialize(hot, "cut-cells")
    cut = F.lit(1)
    if hot.limit(1).count():
        stored, asked, cut = stored.join(hot, "cell", "left"), asked.join(hot, "cell", "left"), F.coalesce("cut", F.lit(1))
    held = stored.select("cell", F.pmod(F.xxhash64("ordinal"), cut).cast("int").alias("block"), F.lit(0).alias("asks"), F.col("ordinal").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    ask = asked.select("cell", F.explode(F.sequence(F.lit(0), (cut - 1).cast("int"))).alias("block"), F.lit(1).alias("asks"), "id", "v")
    return top_k(group_scores(held.unionByName(ask), k), k)
