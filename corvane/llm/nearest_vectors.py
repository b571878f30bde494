"""Problem 4: the most similar vectors of every vector, by additive quantisation.

A vector is approximated by a sum of one codeword from each of several full-dimensional codebooks, chosen by
beam search; the norm of the sum is stored with the codes. The first codebooks also route: their codewords
are cells, a vector is stored in the best cell that beam search found and asks the best few, and further ones that are
hardly worse than its best: how much worse is fitted, by the crowding of the cells around a vector, to a recall
measured by brute force on a sample. Inside a cell the scores of all stored codes come from a lookup table of
query-codeword products and the stored norms; the best of them are scored again exactly, on the vectors themselves,
and so are all where the codes can't tell the best apart.

Codebooks are fitted on a bounded sample; every vector is encoded, stored and asked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column, discard, materialize

#: Vectors that an average cell holds, the most codewords of one routing codebook, and codewords of the others.
CELL, ROUTES, WORDS = 150, 1024, 256
#: A cell with more stored vectors is cut into blocks of about this size, each a group of its own.
BLOCK = 4096
#: Vectors whose neighbours are found by brute force to fit the asked cells, in how many groups by crowding, and the part of the true neighbours that the asked cells of each group must hold.
TRIED, CROWDS, RECALL = 1024, 8, 0.95
#: Part of the true neighbours' cells that the beam search over several routing codebooks must find.
FOUND = 0.995


@dataclass
class Quantizer:
    """`routing` of the codebooks route; beam search keeps `beam` partial sums."""

    books: list[np.ndarray]
    routing: int
    beam: int

    def __post_init__(self):
        self.all = np.concatenate(self.books)
        self.offset = np.cumsum([0, *map(len, self.books)])
        self.cross = self.all @ self.all.T
        self.square = np.diag(self.cross).copy()

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, norm of the decoded vector, best cell)."""
        rows = len(x)
        dots = x @ self.all.T
        codes = np.zeros((rows, 1, 0), np.int64)  # rows, beam, codebooks so far; as indices into all codewords
        cost = np.zeros((rows, 1))
        cells = None
        for m, book in enumerate(self.books):
            lo, hi = self.offset[m], self.offset[m + 1]
            step = self.square[lo:hi] - 2 * dots[:, None, lo:hi]
            step = np.repeat(step, codes.shape[1], 1) if codes.shape[1] > 1 else step
            for j in range(m):
                step = step + 2 * self.cross[codes[:, :, j], lo:hi]
            total = (cost[:, :, None] + step).reshape(rows, -1)
            keep = min(self.beam, total.shape[1])
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep] if keep < total.shape[1] else np.broadcast_to(np.arange(keep), (rows, keep))
            cost = np.take_along_axis(total, best, 1)
            order = np.argsort(cost, axis=1, kind="stable")
            best, cost = np.take_along_axis(best, order, 1), np.take_along_axis(cost, order, 1)
            parent, word = best // len(book), best % len(book) + lo
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], 2)
            if m == self.routing - 1:
                cells = self._cell(codes[:, 0])
        codes = codes[:, 0]
        return codes, np.linalg.norm(sum(self.all[codes[:, j]] for j in range(codes.shape[1])), axis=1), cells

    def _cell(self, codes: np.ndarray) -> np.ndarray:
        cells = np.zeros(codes.shape[:-1], np.int64)
        for j in range(self.routing):
            cells = cells * len(self.books[j]) + codes[..., j] - self.offset[j]
        return cells

    def route(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, squared distances to their codewords' sums) in no order: all cells of one routing codebook, of several the best `width` that beam search finds."""
        codes = np.zeros((len(x), 1, 0), np.int64)
        cost = np.full((len(x), 1), 1.0)  # of unit vectors
        for m in range(self.routing):
            lo, hi = self.offset[m], self.offset[m + 1]
            if m and codes.shape[1] > width:
                best = np.argpartition(cost, width - 1, axis=1)[:, :width]
                codes, cost = np.take_along_axis(codes, best[:, :, None], 1), np.take_along_axis(cost, best, 1)
            step = (self.square[lo:hi] - 2 * (x @ self.all[lo:hi].T))[:, None]
            for j in range(m):
                step = step + 2 * self.cross[codes[:, :, j], lo:hi]
            cost = (cost[:, :, None] + step).reshape(len(x), -1)
            word = np.broadcast_to(np.arange(lo, hi), (len(x), codes.shape[1], hi - lo)).reshape(len(x), -1, 1)
            codes = np.concatenate([np.repeat(codes, hi - lo, 1), word], 2)
        return self._cell(codes), np.maximum(cost, 1e-6)

    def refit(self, x: np.ndarray, ridge: float = 1.0) -> "Quantizer":
        """All codebooks but the routing ones at once, by least squares on the codes of x; cells stay where they are."""
        codes = np.concatenate([self.encode(x[i : i + 1024])[0] for i in range(0, len(x), 1024)])
        first, r = self.offset[self.routing], self.routing
        rest = x - sum(self.all[codes[:, j]] for j in range(r))
        codes, old = codes[:, r:] - first, self.all[first:]
        size = len(old)
        if not size:
            return self
        gram, right = np.zeros((size, size)), np.zeros((size, x.shape[1]))
        for j in range(codes.shape[1]):
            right += _sums(rest, codes[:, j], size)
            for i in range(codes.shape[1]):
                gram += np.bincount(codes[:, j] * size + codes[:, i], minlength=size * size).reshape(size, size)
        # shrunk towards the old codewords, which also keeps those that no vector uses
        new = np.linalg.solve(gram + ridge * np.eye(size), right + ridge * old).astype(np.float32)
        books = self.books[:r] + [new[a - first : b - first] for a, b in zip(self.offset[r:-1], self.offset[r + 1 :], strict=True)]
        return Quantizer(books, r, self.beam)


def _sums(x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sum of the rows of each group."""
    out = np.zeros((groups, x.shape[1]))
    order = np.argsort(group, kind="stable")
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    out[g[starts]] = np.add.reduceat(x[order].astype(np.float64), starts, axis=0)
    return out


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([(x[i : i + 8192] @ centers.T - half).argmax(1) for i in range(0, len(x), 8192)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, _sums(x, near, k) / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return centers


def fit(sample: np.ndarray, rows: int, *, codebooks: int, beam: int, seed: int) -> Quantizer:
    """Codebooks on residuals, then one joint refit. Routing sizes follow the number of rows that will be stored."""
    rng = np.random.default_rng(seed)
    sizes, cells = [], max(1, rows // CELL)
    while True:
        sizes.append(min(cells, ROUTES))
        cells = -(-cells // ROUTES)
        if cells <= 1:
            break
    routing = len(sizes)
    sizes += [WORDS] * max(0, codebooks - routing)
    books, rest = [], sample.astype(np.float32)
    for size in sizes:
        k = max(1, min(size, len(rest) // 20))
        books.append(_kmeans(rest, k, rng))
        rest = rest - books[-1][_nearest(rest, books[-1])]
    return Quantizer(books, routing, beam).refit(sample)


@dataclass
class Reach:
    """The cells a vector asks: the nearest `least`, and those within a multiple of its smallest squared distance. The multiple
    depends on how crowded the cells are: on the distance of the last of `least`, in multiples of the smallest."""

    least: int
    width: int
    crowding: np.ndarray
    multiple: np.ndarray

    def near(self, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(smallest distance, distance of the last of `least` cells)."""
        last = min(self.least, far.shape[1]) - 1
        part = np.partition(far, (0, last) if last else 0, axis=1)
        return part[:, 0], part[:, last]

    def limit(self, far: np.ndarray) -> np.ndarray:
        first, last = self.near(far)
        return np.maximum(last, first * self.multiple[np.searchsorted(self.crowding, last / first)])


def fit_reach(q: Quantizer, x: np.ndarray, cells: np.ndarray, least: int) -> Reach:
    """cells: those that hold the true neighbours of each row of x; -1 where there are fewer."""
    width, total = least, int(np.prod([len(b) for b in q.books[: q.routing]]))
    while True:
        reach = Reach(least, width, np.zeros(0), np.ones(1))
        where, first, last = _distances(q, x, cells, reach)
        # several routing codebooks: their beam search is widened until it finds the cells, all of them if need be
        if q.routing == 1 or width >= total or not (cells >= 0).any() or np.isfinite(where[cells >= 0]).mean() >= FOUND:
            break
        width *= 2
    crowd = last / first
    reach.crowding = np.quantile(crowd, np.arange(1, CROWDS) / CROWDS) if len(x) >= 50 * CROWDS else np.zeros(0)
    group = np.searchsorted(reach.crowding, crowd)
    multiple = np.ones(len(reach.crowding) + 1)
    for g in range(len(multiple)):
        need = np.where(where <= last[:, None], 1.0, where / first[:, None])[(group == g)[:, None] & (cells >= 0)]
        if len(need):
            multiple[g] = np.sort(need)[min(len(need) - 1, int(RECALL * len(need)))] * (1 + 1e-5)
    reach.multiple = multiple
    return reach


def _distances(q: Quantizer, x: np.ndarray, cells: np.ndarray, reach: Reach) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance of each row of x to its given cells, infinite where they aren't found; and what reach.near() gives)."""
    where, near = [], []
    for i in range(0, len(x), 64):
        found, far = q.route(x[i : i + 64], reach.width)
        where.append(np.stack([np.where(found == c[:, None], far, np.inf).min(1) for c in cells[i : i + 64].T], 1))
        near.append(reach.near(far))
    return np.concatenate(where), *map(np.concatenate, zip(*near, strict=True))


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): valid vectors scaled to length 1, as little-endian float32. Null ids, wrong lengths, null or non-finite members and zero vectors give no row."""
    base = df.select(column(df, id_col).cast("long").alias("id"), column(df, vec_col).cast("array<float>").alias("v")).where(f"id is not null and size(v) = {dim}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
                with np.errstate(all="ignore"):
                    norm = np.linalg.norm(x, axis=1)
                    ok = np.flatnonzero(np.isfinite(x).all(1) & (norm > 0))
                    x = (x[ok] / norm[ok, None]).astype("<f4")
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "v"])

    return base.mapInArrow(run, "id long, v binary")


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<f4").reshape(len(col), dim)


class _Cell:
    """The stored rows of one cell (or block of it) and the search among them."""

    def __init__(self, parts: list[pa.RecordBatch], q: Quantizer, dim: int):
        t = pa.Table.from_batches(parts).combine_chunks()
        self.q, self.ids, self.x = q, t.column("id").to_numpy(), _matrix(t.column("v").combine_chunks(), dim)
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), "<u2").reshape(t.num_rows, -1).astype(np.int64) + q.offset[:-1]
        self.norm = np.maximum(t.column("norm").to_numpy(), 1e-9)

    def ask(self, ids: np.ndarray, x: np.ndarray, k: int, rerank: int) -> pa.RecordBatch:
        table = np.ascontiguousarray(x @ self.q.all.T)
        approx = np.zeros((len(x), len(self.ids)), np.float32)
        for j in range(self.codes.shape[1]):
            approx += np.take(table, self.codes[:, j], axis=1)
        approx /= self.norm
        approx[ids[:, None] == self.ids[None, :]] = -np.inf
        r = min(rerank, len(self.ids))
        best = np.argpartition(approx, -r, axis=1)[:, -r:] if r < len(self.ids) else np.broadcast_to(np.arange(r), (len(x), r))
        exact, near = np.einsum("qrd,qd->qr", self.x[best], x).astype(np.float64), self.ids[best]
        if k < r < len(self.ids):
            # the largest error seen among the scored ones: rows where more than `rerank` could still be among the best k are scored whole
            seen = np.where(near == ids[:, None], -np.inf, exact)
            error = np.where(np.isfinite(seen), exact - np.take_along_axis(approx, best, 1), 0).max(1)
            kth = np.partition(seen, r - k, axis=1)[:, r - k]
            whole = np.flatnonzero((approx > (kth - error)[:, None]).sum(1) > r)
            if len(whole):
                score = x[whole] @ self.x.T
                score[ids[whole, None] == self.ids[None, :]] = -np.inf
                top = np.argpartition(score, -r, axis=1)[:, -r:]
                exact[whole], near[whole] = np.einsum("qrd,qd->qr", self.x[top], x[whole]), self.ids[top]
        exact[near == ids[:, None]] = -np.inf
        order = np.lexsort((near, -exact), axis=1)[:, :k]
        exact, near = np.take_along_axis(exact, order, 1), np.take_along_axis(near, order, 1)
        real = np.isfinite(exact)
        offsets = np.r_[0, np.cumsum(real.sum(1))].astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(-exact[real]), pa.array(near[real])], ["far", "id"])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pairs)], ["id", "near"])


def _scorer(shared, dim: int, k: int, rerank: int):
    """Over rows sorted by (cell, block, asks): stored rows come first in a group and are held, asking rows stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        group, parts, cell = None, [], None

        def close():  # the stored rows are complete: they ask too
            c = _Cell(parts, q, dim)
            return c, [c.ask(c.ids[i : i + 512], c.x[i : i + 512], k, rerank) for i in range(0, len(c.ids), 512)]

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("cell", "block", "asks")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
                part, key, asks = batch.slice(lo, hi - lo), (keys[0][lo], keys[1][lo]), keys[2][lo]
                if parts and (key != group or asks):
                    cell, own = close()
                    parts = []
                    yield from own
                if key != group:
                    group, cell = key, None
                if not asks:
                    parts.append(part)
                elif cell is not None:
                    ids, x = part.column("id").to_numpy(), _matrix(part.column("v"), dim)
                    for i in range(0, len(ids), 512):
                        yield cell.ask(ids[i : i + 512], x[i : i + 512], k, rerank)
        if parts:
            yield from close()[1]

    return run


def nearest_vectors(df: DataFrame, id_col: str, vec_col: str, *, dim: int, k: int = 5, codebooks: int = 10, beam: int = 4, rerank: int = 96, sample: int = 40_000, seed: int = 5) -> DataFrame:
    """(id, near): for each valid vector an array of its k nearest others, as (cosine, id) from best to worst.

    Approximate: each vector asks `beam` cells at least, more where a measured recall needs them, and scores `rerank` of a cell
    exactly, or all if the codes can't tell the best apart; the returned cosines are exact. Vectors
    that unit_vectors() leaves out take no part; with n of them left each gets min(k, n - 1) neighbours at most, a single one the empty array.
    Ids must be unique; equal vectors are neighbours with cosine 1; at ties the smaller id comes first. The codebooks
    are fitted on at most `sample` vectors, drawn by a hash of their ids.
    """
    vectors = materialize(unit_vectors(df, id_col, vec_col, dim), "unit-vectors")
    # Copies of a vector are searched once: its k + 1 smallest ids stand for all of them, however many there are.
    keyed = vectors.select("id", F.md5("v").alias("h"))
    copied = materialize(keyed.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copied-vectors")
    search = dict(dim=dim, k=k, codebooks=codebooks, beam=beam, rerank=rerank, sample=sample, seed=seed)
    if not copied.limit(1).count():
        return _search(vectors, **search)
    members = materialize(keyed.join(copied, "h").select("id", "rep"), "vector-copies")
    near = _search(vectors.join(members.where("id != rep"), "id", "left_anti"), **search)
    first = Window.partitionBy("rep").orderBy("id")
    some = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.collect_list("id").alias("some"))
    asked = near.select(F.col("id").alias("rep"), F.explode_outer("near").alias("x")).select("rep", F.col("x.id").alias("other"), F.col("x.cosine").alias("cosine"))
    others = asked.join(some.select(F.col("rep").alias("other"), F.col("some").alias("theirs")), "other", "left").where("other is not null")
    others = others.select("rep", "cosine", F.explode(F.coalesce("theirs", F.array("other"))).alias("id"))
    own = some.select("rep", F.lit(1.0).alias("cosine"), F.explode("some").alias("id"))
    # At most (k + 1)^2 rows a representative.
    lists = others.unionByName(own).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "id"))).alias("near"))
    every = vectors.select("id").join(members, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    near = every.join(lists, "rep").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return near.select("id", F.transform("near", lambda x: F.struct((-x["far"]).alias("cosine"), x["id"].alias("id"))).alias("near"))


def _search(vectors: DataFrame, *, dim: int, k: int, codebooks: int, beam: int, rerank: int, sample: int, seed: int) -> DataFrame:
    """The search among different vectors."""
    spark, rows = vectors.sparkSession, vectors.count()
    if not rows:
        return spark.createDataFrame([], "id long, near array<struct<cosine: double, id: bigint>>")
    # a cut on the hash first: only a little more than the sample is sorted
    share = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, 1.1 * sample / rows) * (1 << 30))
    drawn = vectors.where(share).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    quantizer = spark.sparkContext.broadcast(fit(_matrix(drawn, dim), rows, codebooks=codebooks, beam=beam, seed=seed))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = quantizer.value
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                codes, norm, cells = q.encode(_matrix(b.column("v"), dim))
                flat = pa.array([c.tobytes() for c in (codes - q.offset[:-1]).astype("<u2")], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, flat, pa.array(norm.astype(np.float32)), pa.array(cells)], ["id", "v", "codes", "norm", "cell"])

    encoded = materialize(vectors.mapInArrow(encode, "id long, v binary, codes binary, norm float, cell long"), "encoded")
    discard(vectors)  # its columns are in the encoded table; a table with copies is a join, and stays
    reach = spark.sparkContext.broadcast(_reach(encoded, quantizer.value, rows, dim=dim, k=k, beam=beam, seed=seed))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once as stored in its cell, with its codes, and once for each other cell that it asks, without them."""
        q, r = quantizer.value, reach.value
        step = 256 if q.routing == 1 else 32
        for big in batches:
            for at in range(0, big.num_rows, step):
                b = big.slice(at, step)
                own, everyone = b.column("cell").to_numpy(), np.arange(b.num_rows)
                cells, far = q.route(_matrix(b.column("v"), dim), r.width)
                row, col = np.nonzero(far <= r.limit(far)[:, None])
                cell = cells[row, col]
                other = cell != own[row]
                row, cell = row[other], cell[other]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(own), np.int32)), *(b.column(c) for c in ("id", "v", "codes", "norm"))], ["cell", "asks", "id", "v", "codes", "norm"])
                for i in range(0, len(row), 4096):
                    few = pa.array(row[i : i + 4096])
                    n = len(few)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + 4096]), pa.array(np.ones(n, np.int32)), b.column("id").take(few), b.column("v").take(few), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float32())], ["cell", "asks", "id", "v", "codes", "norm"])

    # Cells of more than BLOCK vectors, at most rows / BLOCK: their numbers of blocks are joined.
    hot = materialize(encoded.groupBy("cell").count().where(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("cut")), "hot-cells")
    routed = encoded.mapInArrow(ask, "cell long, asks int, id long, v binary, codes binary, norm float")
    blocks = F.lit(1)
    if hot.limit(1).count():
        small = hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        routed, blocks = routed.join(F.broadcast(hot) if small else hot, "cell", "left"), F.coalesce("cut", F.lit(1))
    routed = routed.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    stored = (F.col("asks") == 0) & (F.col("own") == F.col("block"))
    routed = routed.select("cell", "block", F.when(stored, 0).otherwise(1).cast("int").alias("asks"), "id", "v", F.when(stored, F.col("codes")).alias("codes"), F.when(stored, F.col("norm")).alias("norm"))

    found = routed.repartition("cell", "block").sortWithinPartitions("cell", "block", "asks").mapInArrow(_scorer(quantizer, dim, k, rerank), "id long, near array<struct<far: double, id: bigint>>")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    merged = found.groupBy("id").agg(best.alias("near"))
    return merged.select("id", F.transform("near", lambda x: F.struct((-x["far"]).alias("cosine"), x["id"].alias("id"))).alias("near"))


def _reach(encoded: DataFrame, q: Quantizer, rows: int, *, dim: int, k: int, beam: int, seed: int) -> Reach:
    """Fitted on the true neighbours of a sample of the vectors, found among all of them by brute force."""
    spark = encoded.sparkSession
    share = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) < int(min(1.0, 1.5 * TRIED / rows + 1e-6) * (1 << 30))
    tried = encoded.where(share).orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(TRIED).select("id", "v").toArrow().combine_chunks()
    ids = tried.column("id").to_numpy()
    x = _matrix(tried.column("v").combine_chunks(), dim) if len(ids) else np.zeros((0, dim), np.float32)
    if not len(ids) or q.routing == 1 and len(q.books[0]) <= beam:
        return Reach(beam, beam, np.zeros(0), np.ones(1))
    shared = spark.sparkContext.broadcast((ids, x))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, y = shared.value
        score, cell = np.full((len(asked), k), -np.inf, np.float32), np.full((len(asked), k), -1)
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                s = y @ _matrix(b.column("v"), dim).T
                s[asked[:, None] == b.column("id").to_numpy()[None, :]] = -np.inf
                s, c = np.concatenate([score, s], 1), np.concatenate([cell, np.broadcast_to(b.column("cell").to_numpy(), s.shape)], 1)
                best = np.argpartition(s, -k, axis=1)[:, -k:]
                score, cell = np.take_along_axis(s, best, 1), np.take_along_axis(c, best, 1)
        at, _ = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(score[np.isfinite(score)]), pa.array(cell[np.isfinite(score)])], ["at", "score", "cell"])

    found = encoded.select("id", "v", "cell").mapInArrow(brute, "at long, score float, cell long")
    best = found.groupBy("at").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "cell"))), 1, k).alias("near"))  # k rows a task and vector
    cells = np.full((len(ids), k), -1)
    for at, near in best.select("at", "near.cell").toLocalIterator():
        cells[at, : len(near)] = near
    return fit_reach(q, x, cells, beam)
