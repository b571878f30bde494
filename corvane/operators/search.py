"""Search: exact top-k, candidate reranking, and the verbs built on them, each over a whole table of queries.

Every non-exact verb ends in the same exact rerank, so a returned score is always a cosine of stored vectors. Tables:
vectors(ordinal, embedding) and queries(qid, query), both of arrays; results are (qid, rank, ordinal, score).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.vectors import all_finite, dot, l2_norm, l2_normalize, score_order
from .cells import SCORE_ROOM, best_of, group_scores, matrix
from .graph import bounded_bfs
from .lexical import bm25_search

#: Queries that are broadcast to every scoring task, at most (8 bytes a number: 16 MB at 512 dimensions).
QUERY_BLOCK = 4096
#: Stored vectors of one group, about, where more queries ask than are broadcast.
VECTOR_GROUP = 8192


def check_query(vector: list[float], k: int, dim: int) -> list[float]:
    """Refuse what cannot be answered; return the vector scaled to length 1."""
    if k < 1:
        raise QueryError("k must be at least 1")
    if not vector:
        raise QueryError("the query vector is empty")
    if len(vector) != dim:
        raise QueryError(f"the query has {len(vector)} dimensions, the corpus {dim}")
    if not all(map(isfinite, vector)):
        raise QueryError("the query vector has a number that is not finite")
    norm = sum(x * x for x in vector) ** 0.5
    if norm == 0:
        raise QueryError("the query vector is zero")
    return [x / norm for x in vector]


def split_queries(queries: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected has the query's qid and a reason."""
    reason = (
        F.when(F.col("query").isNull() | (F.size("query") == 0), "empty")
        .when(F.size("query") != dim, "dimension")
        .when(~all_finite("query"), "not finite")
        .when(l2_norm("query") == 0, "zero")
    )
    marked = queries.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("qid", "reason")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(qid, rank, ordinal, score): ranks from 1; NaN last, ties by ordinal. Catalyst cuts each partition to k before the shuffle."""
    if k < 1:
        raise QueryError("k must be at least 1")
    w = Window.partitionBy("qid").orderBy(*score_order("score", "ordinal"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "ordinal", "score")


def exact_search(vectors: DataFrame, queries: DataFrame, k: int, *, normalized: bool = False) -> DataFrame:
    """Score every vector for every query and keep the best k per query.

    Up to QUERY_BLOCK queries are broadcast (their size is bounded) and multiplied with the vectors batch by batch, without a shuffle of vectors;
    only the best k of a batch leave the task. More queries meet the vectors in groups of about VECTOR_GROUP: a vector is shuffled once, a
    query once for each group. That is the whole product of both tables: where all rows ask all rows, ann_search() is meant.
    `normalized` says that stored vectors have length 1; otherwise their norms divide. A query with k or fewer vectors gets them all.
    Null vectors have no score. The number of queries is counted when it is called.
    """
    if k < 1:
        raise QueryError("k must be at least 1")
    q = queries.select(F.col("qid").cast("long").alias("id"), l2_normalize("query").cast("array<double>").alias("v")).where("v is not null")
    head = q.limit(QUERY_BLOCK + 1).toArrow().combine_chunks()
    if not head.num_rows:
        return vectors.sparkSession.createDataFrame([], "qid long, rank int, ordinal long, score double")
    if head.num_rows <= QUERY_BLOCK:
        ids, x = head.column("id").to_numpy(), matrix(head.column("v").combine_chunks(), head.num_rows)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, x))
        return top_k(vectors.select("ordinal", "embedding").mapInArrow(_matmul(shared, k, normalized), "qid long, ordinal long, score double"), k)
    stored = vectors.where("embedding is not null").select(F.col("ordinal").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    groups = max(1, -(-stored.count() // VECTOR_GROUP))
    held = stored.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("cell"), F.lit(0).alias("block"), F.lit(0).alias("asks"), "id", "v")
    ask = q.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("cell"), F.lit(0).alias("block"), F.lit(1).alias("asks"), "id", "v")
    return top_k(group_scores(held.unionByName(ask), k, normalized=normalized), k)


def _matmul(shared, k: int, normalized: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        step = max(256, min(16_384, SCORE_ROOM // max(len(qids), 1)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                b = b.filter(b.column("embedding").is_valid())
                if not b.num_rows:
                    continue
                ordinal = b.column("ordinal").cast(pa.int64()).to_numpy()
                order = np.argsort(ordinal, kind="stable")
                x = matrix(b.column("embedding"), b.num_rows)[order]
                yield best_of(qids, q, ordinal[order], x, None if normalized else np.linalg.norm(x, axis=1), k)

    return run


def rerank(vectors: DataFrame, queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Exact cosines of candidate (qid, ordinal) rows, each counted once, and the best k per query."""
    once = candidates.select("qid", "ordinal").distinct()
    q = queries.select("qid", l2_normalize("query").alias("_q"))
    rows = once.join(vectors.select("ordinal", "embedding"), "ordinal").join(q, "qid")
    return top_k(rows.select("qid", "ordinal", (dot("embedding", "_q") / l2_norm("embedding")).alias("score")), k)


def graph_search(vectors: DataFrame, edges: DataFrame, queries: DataFrame, k: int, *, hops: int = 1, ef: int = 100) -> DataFrame:
    """Seeds are the exact best max(ef, k); a bounded walk of `hops` levels, at most 8 times the seeds, adds neighbours; all are reranked."""
    seeds = exact_search(vectors, queries, max(ef, k))
    width = 8 * max(ef, k)
    seen = bounded_bfs(edges, seeds.select("qid", F.col("ordinal").alias("node"), F.col("rank").alias("arrival")), hops=hops, max_frontier=width)
    return rerank(vectors, queries, seen.select("qid", F.col("node").alias("ordinal")), k)


def hybrid_search(vectors: DataFrame, queries: DataFrame, texts: DataFrame, index: dict[str, DataFrame] | None, k: int, *, candidates: int = 64, ann=None) -> DataFrame:
    """Vector candidates and lexical candidates together, reranked. texts is (qid, text).

    Vector candidates come from ann(queries, width) if given, else from the exact search. Without a lexical index only the vector
    candidates count, so fewer than k rows may come out when candidates < k.
    """
    near = ann(queries, max(candidates, k)) if ann else exact_search(vectors, queries, candidates)
    union = near.select("qid", "ordinal")
    if index is not None:
        union = union.unionByName(bm25_search(index, texts, candidates).select("qid", "ordinal"))
    return rerank(vectors, queries, union, k)


def neighbor_context(chunks: DataFrame, radius: int = 1, joiner: str = " ") -> DataFrame:
    """(ordinal, context): texts of the ordinals within `radius`, joined in order, clamped at both ends.

    Ordinals meet through an equi-join on shifted copies, not through one window over the whole table.
    """
    spots = F.sequence(F.col("ordinal") - radius, F.col("ordinal") + radius)
    shifted = chunks.select(F.explode(spots).alias("_at"), F.col("ordinal").alias("_from"), F.coalesce("canonical_text", F.lit("")).alias("_text"))
    gathered = chunks.select("ordinal").join(shifted, F.col("ordinal") == F.col("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_from", "_text")))
    return gathered.groupBy("ordinal").agg(F.array_join(F.transform(ordered, lambda x: x["_text"]), joiner).alias("context"))
