"""Problem 2: how distinctive a term is for its record.

One table of statistics feeds two weights. `divergence` is a term's contribution to the relative entropy between the
record's Dirichlet-smoothed language model and the collection's, with a least document frequency. `saturated` is the
inverse document frequency times a saturated, length-normalised term frequency.

Rows travel as (record, 64-bit hash of the term, frequency) of fixed width; strings are only looked up for the terms that win
or are asked for. The seed of the hash is one under which no two terms of the collection share a hash, which is counted. The
statistics of frequent terms, a bounded number, are broadcast; those of the others, none of which has many rows, meet their rows
in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize

#: Terms whose statistics are broadcast, at most: 24 bytes each, so 12 MB.
HEAD_TERMS = 500_000
#: Values that a task sums at once.
_ROOM = 2_000_000

#: (tf, df, cf, dl, n, avgdl, total) -> weight, on arrays.
Weight = Callable[..., np.ndarray]


def divergence(mu: float) -> Weight:
    def weight(tf, df, cf, dl, n, avgdl, total):
        p_c = cf / total
        p_d = (tf + mu * p_c) / (dl + mu)
        return p_d * np.log(p_d / p_c)

    return weight


def saturated(k1: float, b: float) -> Weight:
    def weight(tf, df, cf, dl, n, avgdl, total):
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / avgdl))

    return weight


def _records(rows: DataFrame) -> DataFrame:
    """(id, dl, h, tf): one row a record, its terms' hashes and frequencies as packed int64; repeats of a (record, term) become the largest."""

    def pack(ids: np.ndarray, h: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((tf, h, ids))
        ids, h, tf = ids[order], h[order], tf[order]
        keep = np.r_[(ids[1:] != ids[:-1]) | (h[1:] != h[:-1]), True]
        ids, h, tf = ids[keep], h[keep], tf[keep]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ends = np.r_[starts[1:], len(ids)]
        packed = (pa.array([x[a:z].tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary()) for x in (h, tf))
        return pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(np.add.reduceat(tf, starts)), *packed], ["id", "dl", "h", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the record that is still open
        for b in batches:
            if not b.num_rows:
                continue
            part = tuple(c.to_numpy() for c in b.columns)
            at = int(np.searchsorted(part[0], part[0][-1]))
            if held and (at or part[0][0] != held[0][0][0]):
                closed = [x[:at] for x in part]
                yield pack(*(np.concatenate(x) for x in zip(*held, closed, strict=True)))
                held = []
            elif at:
                yield pack(*(x[:at] for x in part))
            held.append(tuple(x[at:] for x in part))
        if held:
            yield pack(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(run, "id long, dl long, h binary, tf binary")


def _packed(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(name).to_pylist()), "<i8")


def _statistics(records: DataFrame) -> DataFrame:
    """(h, df, cf) of every term; counted in arrays inside a task before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            h, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, tf = h[order], tf[order]
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(h[starts]), pa.array(np.diff(np.r_[starts, len(h)])), pa.array(np.add.reduceat(tf, starts))], ["h", "df", "cf"])

        for b in batches:
            if b.num_rows:
                held.append((_packed(b, "h"), _packed(b, "tf")))
                size += len(held[-1][0])
                if size > _ROOM:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return records.select("h", "tf").mapInArrow(run, "h long, df long, cf long").groupBy("h").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


class _Collection:
    """What all weights of one table of postings share."""

    def __init__(self, postings: DataFrame, id_col: str, term_col: str, tf_col: str, head_terms: int):
        rows = postings.select(column(postings, id_col).cast("long").alias("id"), column(postings, term_col).alias("term"), column(postings, tf_col).cast("long").alias("tf"))
        rows = rows.where("id is not null and term is not null and tf >= 1")
        names = materialize(rows.select("term").distinct(), "terms")
        terms = names.count()
        for seed in range(42, 74):
            hashed = F.xxhash64("term", F.lit(seed))
            self.names = names.select(hashed.alias("h"), "term")
            if self.names.select("h").distinct().count() == terms:
                break
        self.records = materialize(_records(rows.select("id", hashed.alias("h"), "tf")), "records")
        n, total = self.records.agg(F.count("*"), F.sum("dl")).first()
        self.n, self.total = float(n), float(total or 1)
        self.avgdl = self.total / max(n, 1)
        self.stats = materialize(_statistics(self.records), "term-statistics")
        # The least power of two from which on there are at most head_terms terms of that frequency.
        room, self.least = head_terms, 1
        for power, count in self.stats.groupBy(F.floor(F.log2("df")).alias("p")).count().orderBy(F.desc("p")).collect():  # at most 63 rows
            room -= count
            if room < 0:
                self.least = 1 << (int(power) + 1)
                break
        head = self.stats.where(F.col("df") >= self.least).toArrow()
        h, df, cf = (head.column(c).to_numpy() for c in ("h", "df", "cf"))
        order = np.argsort(h)
        self.head = rows.sparkSession.sparkContext.broadcast((h[order], df[order], cf[order]))

    def weighed(self, weight: Weight, least_df: int, best: bool) -> DataFrame:
        """(id, h, tf, weight) of all terms, or with `best` of those that may be their record's best."""
        n, avgdl, total, shared = self.n, self.avgdl, self.total, self.head
        names = ["id", "h", "tf", "dl", "weight"]

        def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hs, dfs, cfs = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                sizes = np.fromiter((len(x) // 8 for x in b.column("h").to_pylist()), np.int64, b.num_rows)
                owner, h, tf = np.repeat(np.arange(b.num_rows), sizes), _packed(b, "h"), _packed(b, "tf")
                at = np.minimum(np.searchsorted(hs, h), max(len(hs) - 1, 0)) if len(hs) else np.zeros(len(h), np.int64)
                known = hs[at] == h if len(hs) else np.zeros(len(h), bool)
                ids, dl = b.column("id").to_numpy(), b.column("dl").to_numpy()
                w = np.full(len(h), np.nan)
                w[known] = np.round(weight(tf[known].astype(float), dfs[at[known]].astype(float), cfs[at[known]].astype(float), dl[owner[known]].astype(float), n, avgdl, total), 9)
                out = ~known
                kept = known.copy()
                if len(hs):
                    kept &= dfs[at] >= least_df
                if best:
                    top = np.full(b.num_rows, -np.inf)
                    np.maximum.at(top, owner[kept], w[kept])
                    kept &= w == top[owner]
                pick = np.flatnonzero(out | kept)
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner[pick]]), pa.array(h[pick]), pa.array(tf[pick]), pa.array(dl[owner[pick]]), pa.array(w[pick], from_pandas=True)], names)

        def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tf, df, cf, dl = (b.column(c).to_numpy().astype(float) for c in ("tf", "df", "cf", "dl"))
                w = np.round(weight(tf, df, cf, dl, n, avgdl, total), 9)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), b.column("tf"), pa.array(w)], ["id", "h", "tf", "weight"])

        rows = self.records.mapInArrow(head, "id long, h long, tf long, dl long, weight double")
        if self.least <= 1:  # every term is in the head
            return rows.select("id", "h", "tf", "weight")
        rows = materialize(rows, "weighed")
        few = self.stats.where((F.col("df") < self.least) & (F.col("df") >= least_df))
        rest = rows.where("weight is null").drop("weight").join(few, "h").mapInArrow(tail, "id long, h long, tf long, weight double")
        every = rows.where("weight is not null").select("id", "h", "tf", "weight").unionByName(rest)
        if not best:
            return every
        every = materialize(every, "weighed-terms")
        top = every.groupBy("id").agg(F.max("weight").alias("top"))
        return every.join(top, "id").where("weight = top").drop("top")


def weighted_terms(postings: DataFrame, id_col: str, term_col: str, tf_col: str, weight: Weight, *, least_df: int = 1, head_terms: int = HEAD_TERMS) -> DataFrame:
    """(id, term, tf, weight): the weight of every term in every record, rounded to 9 digits.

    Rows with a null id, term or tf, or a tf below 1, are left out; of repeated rows of a (term, id) the largest tf
    counts. `weight` takes arrays of tf, df, cf (occurrences of the term), dl (of the record), and the numbers n (records), avgdl and total
    (occurrences of all terms). Statistics are of all records; least_df only drops terms from the result. An empty table
    gives an empty result; other columns are ignored. Jobs run when it is called: statistics, and the tables behind them.
    """
    c = _Collection(postings, id_col, term_col, tf_col, head_terms)
    return c.weighed(weight, least_df, best=False).join(c.names, "h").select("id", "term", "tf", "weight")


def most_distinctive_terms(postings: DataFrame, id_col: str, term_col: str, tf_col: str, weight: Weight, *, least_df: int = 1, head_terms: int = HEAD_TERMS) -> DataFrame:
    """(id, term, weight): the term of highest weight of each record, at a tie the smallest term by its UTF-8 bytes.

    The rows of weighted_terms(), of which only a record's best ones, and their ties, leave a task.
    """
    c = _Collection(postings, id_col, term_col, tf_col, head_terms)
    tied = c.weighed(weight, least_df, best=True).join(c.names, "h")
    return tied.groupBy("id").agg(F.min("term").alias("term"), F.max("weight").alias("weight"))


def most_distinctive(weighted: DataFrame) -> DataFrame:
    """(id, term, weight): the same from a table of weights."""
    best = F.min_by(F.struct("term", "weight"), F.struct(-F.col("weight"), F.col("term")))
    return weighted.groupBy("id").agg(best.alias("best")).select("id", "best.term", "best.weight")
