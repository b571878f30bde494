"""BM25: the inverted index as tables, search over a table of queries, and rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..functions.vectors import score_order
from ..tables import materialize

K1, B = 1.5, 0.75


def bm25_build(chunks: DataFrame, *, text_col: str = "canonical_text") -> dict[str, DataFrame]:
    """postings(term, ordinal, tf), terms(term, df), doc_stats(ordinal, dl), corpus(n_docs, avgdl).

    Every chunk counts as a document, null and empty texts with length 0. Texts are read and cut into terms once: the postings
    are written to the shared folder, and everything else follows from them and the ordinals.
    """
    tokens = chunks.select("ordinal", F.explode(lexical_tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    postings = materialize(tokens.groupBy("term", "ordinal").agg(F.count("*").alias("tf")), "postings")
    lengths = postings.groupBy("ordinal").agg(F.sum("tf").alias("dl"))
    doc_stats = chunks.select("ordinal").join(lengths, "ordinal", "left").select("ordinal", F.coalesce("dl", F.lit(0)).alias("dl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    corpus = doc_stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    return {"postings": postings, "terms": terms, "doc_stats": doc_stats, "corpus": corpus}


def bm25_scores(index: dict[str, DataFrame], texts: DataFrame, *, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, ordinal, score): a query term that occurs twice counts twice; scores that are not finite are dropped."""
    q = texts.select("qid", F.explode(lexical_tokens(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    corpus = F.broadcast(index["corpus"])  # one row
    rows = q.join(index["terms"], "term").join(index["postings"], "term").join(index["doc_stats"], "ordinal").crossJoin(corpus)
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1.0))))
    scores = rows.groupBy("qid", "ordinal").agg(F.sum(part * F.col("times")).alias("score"))
    return scores.where(~F.isnan("score") & (F.abs("score") < float("inf")))


def bm25_search(index: dict[str, DataFrame], texts: DataFrame, k: int, *, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, rank, ordinal, score) of the best k; an empty query has no rows."""
    w = Window.partitionBy("qid").orderBy(*score_order("score", "ordinal"))
    ranked = bm25_scores(index, texts, k1=k1, b=b).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "ordinal", "score")


def rrf_union(*lists: DataFrame, constant: int = 60) -> DataFrame:
    """(qid, rank, ordinal, score): the sum of 1 / (constant + rank) over ranked lists (qid, rank from 1, ordinal)."""
    union = lists[0].select("qid", "rank", "ordinal")
    for x in lists[1:]:
        union = union.unionByName(x.select("qid", "rank", "ordinal"))
    fused = union.groupBy("qid", "ordinal").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    w = Window.partitionBy("qid").orderBy(*score_order("score", "ordinal"))
    return fused.select("qid", F.row_number().over(w).alias("rank"), "ordinal", "score")


def invalid_postings(index: dict[str, DataFrame], *, k1: float = K1, b: float = B) -> DataFrame:
    """(problem, n): what breaks the index's own rules; empty if it is sound."""
    p, t, d, c = index["postings"], index["terms"], index["doc_stats"], index["corpus"]
    lengths = p.groupBy("ordinal").agg(F.sum("tf").alias("n"))
    real = d.agg(F.count("*").alias("_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("_avg"))
    found = [
        (p.where("tf < 1 or tf is null"), "tf below 1"),
        (p.groupBy("term", "ordinal").count().where("count > 1"), "repeated posting"),
        (p.join(d, "ordinal", "left_anti"), "posting of an unknown document"),
        (t.join(p.groupBy("term").agg(F.count("*").alias("n")), "term", "full").where("not (df <=> n)"), "df differs from the postings"),
        (d.where("dl < 0 or dl is null"), "negative length"),
        (d.join(lengths, "ordinal", "left").where("not (dl <=> coalesce(n, 0))"), "length differs from the postings"),
        (d.groupBy("ordinal").count().where("count > 1"), "repeated document"),
        (c.crossJoin(real).where("n_docs != _docs or n_docs is null"), "number of documents"),  # one row each
        (c.crossJoin(real).where("avgdl is null or isnan(avgdl) or abs(avgdl - _avg) > 1e-9 * greatest(1, _avg)"), "average length"),
    ]
    rows = [r.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(problem).alias("problem"), "n") for r, problem in found]
    if not (0 <= k1 < float("inf") and 0 <= b <= 1):
        rows.append(p.sparkSession.createDataFrame([("k1 or b out of range", 1)], "problem string, n long"))
    out = rows[0]
    for n in rows[1:]:
        out = out.unionByName(n)
    return out
