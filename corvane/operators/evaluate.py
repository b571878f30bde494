"""Evaluation: recall, precision, ranks, drift, agreement, and tests of differences, as aggregations over result tables.

Ranked results are (qid, rank from 1, ordinal[, score]).
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .dedup import dense_index

RESAMPLES = 5000


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): share of the first k true ordinals that are among the first k found; every query of truth has a row."""
    t = truth.where(F.col("rank") <= k).select("qid", "ordinal").distinct()
    f = found.where(F.col("rank") <= k).select("qid", "ordinal", F.lit(1).alias("hit")).distinct()
    return t.join(f, ["qid", "ordinal"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))


def identity_recall(found: DataFrame, k: int) -> DataFrame:
    """(k, recall): share of queries that find themselves (qid = ordinal) among the first k."""
    per = found.groupBy("qid").agg(F.max(((F.col("rank") <= k) & (F.col("qid") == F.col("ordinal"))).cast("int")).alias("hit"))
    return per.agg(F.lit(k).alias("k"), F.avg("hit").alias("recall"))


def label_precision(found: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(qid, precision, hit): the label ruler; a query's own row is left out and the next k count. labels is (ordinal, label); unlabelled queries have no row."""
    named = labels.where("label is not null and label != ''")
    w = Window.partitionBy("qid").orderBy("rank")
    others = found.where("qid != ordinal").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    own = named.select(F.col("ordinal").alias("qid"), F.col("label").alias("_own"))
    rows = others.join(own, "qid").join(labels.select("ordinal", F.col("label").alias("_theirs")), "ordinal", "left")
    same = F.coalesce((F.col("_own") == F.col("_theirs")).cast("int"), F.lit(0))
    return rows.groupBy("qid").agg(F.avg(same).alias("precision"), F.max(same).alias("hit"))


def random_label_precision(labels: DataFrame) -> DataFrame:
    """(precision): the chance that two items drawn at random share a label; null for fewer than two labelled items."""
    counts = labels.where("label is not null and label != ''").groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    rows = counts.crossJoin(F.broadcast(total))  # one row
    return rows.agg(F.when(F.max("total") > 1, F.sum(F.col("n") / F.col("total") * (F.col("n") - 1) / (F.col("total") - 1))).alias("precision"))


def mean_reciprocal_rank(found: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """(mrr, hit_at_<k>...): over all queries of gold(qid, ordinal); a gold item that isn't found counts 0."""
    ranks = gold.join(found.select("qid", "ordinal", "rank"), ["qid", "ordinal"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    hits = [F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"hit_at_{k}") for k in ks]
    return ranks.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), *hits)


def leakage(found: DataFrame, negatives: DataFrame, k: int) -> DataFrame:
    """(leakage): share of queries with a negative item (qid, ordinal) among the first k."""
    top = found.where(F.col("rank") <= k)
    bad = top.join(negatives.select("qid", "ordinal").distinct(), ["qid", "ordinal"], "left_semi").select("qid").distinct().withColumn("bad", F.lit(1))
    return found.select("qid").distinct().join(bad, "qid", "left").agg(F.avg(F.coalesce("bad", F.lit(0))).alias("leakage"))


def hit_at_1(scores: DataFrame) -> DataFrame:
    """(hit): share of queries whose best-scored item (smallest id at ties) is the gold one; scores is (qid, ordinal, score, is_gold)."""
    best = scores.groupBy("qid").agg(F.min_by("is_gold", F.struct(F.isnan("score"), -F.col("score"), F.col("ordinal"))).alias("g"))
    return best.agg(F.avg(F.col("g").cast("int")).alias("hit"))


def linear_percentiles(df: DataFrame, column: str, points: list[float]) -> DataFrame:
    """One row with p<percent> columns, by linear interpolation."""
    return df.agg(*(F.percentile(column, p).alias(f"p{round(p * 100):02d}") for p in points))


def nearest_rank(df: DataFrame, column: str, p: float, *, half: str = "even") -> DataFrame:
    """(value): the element at round(p * (n - 1)), halves to even or away from zero."""
    rows = df.where(F.col(column).isNotNull()).select(column)
    at = p * (rows.count() - 1)
    return dense_index(rows, column, "_i").where(F.col("_i") == (round(at) if half == "even" else int(at + 0.5))).select(F.col(column).alias("value"))


def drift(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """min, p05, p25, median, p75, p95, max of the cosines between two vectors of each row."""
    c = pairs.select(cosine(a, b).alias("c"))
    named = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return c.agg(F.min("c").alias("min"), *(F.percentile("c", p).alias(n) for n, p in named.items()), F.max("c").alias("max"))


def ranking_agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(qid, overlap, tau): shared items of both top-k over k, and (concordant - discordant) / pairs among the shared ones; tau is null for fewer than two."""
    x = a.where(F.col("rank") <= k).select("qid", "ordinal", F.col("rank").alias("ra"))
    y = b.where(F.col("rank") <= k).select("qid", "ordinal", F.col("rank").alias("rb"))
    shared = x.join(y, ["qid", "ordinal"])
    p, q = shared.alias("p"), shared.alias("q")
    pairs = p.join(q, F.expr("p.qid = q.qid and p.ordinal < q.ordinal")).select(F.col("p.qid").alias("qid"), F.signum((F.col("p.ra") - F.col("q.ra")) * (F.col("p.rb") - F.col("q.rb"))).alias("s"))
    tau = pairs.groupBy("qid").agg((F.sum("s") / F.sum(F.abs("s"))).alias("tau"))
    both = x.select("qid").distinct().join(y.select("qid").distinct(), "qid")
    n = shared.groupBy("qid").agg(F.count("*").alias("n"))
    return both.join(n, "qid", "left").join(tau, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / k).alias("overlap"), "tau")


def sign_counts(pairs: DataFrame, sample: str = "sample", control: str = "control") -> DataFrame:
    """(pos, neg): how often the sample is above and below the control."""
    d = F.col(sample) - F.col(control)
    return pairs.agg(F.sum((d > 0).cast("int")).alias("pos"), F.sum((d < 0).cast("int")).alias("neg"))


def sign_test(pairs: DataFrame, sample: str = "sample", control: str = "control") -> dict:
    """Exact two-sided binomial test on the counts; no difference at all gives p = 1."""
    pos, neg = (x or 0 for x in sign_counts(pairs, sample, control).first())
    n = pos + neg
    tail = sum(comb(n, i) for i in range(min(pos, neg) + 1))
    return {"pos": pos, "neg": neg, "p_value": min(1.0, 2.0 * tail / 2**n) if n else 1.0}


def _bootstrap(diff: np.ndarray, seed: int) -> tuple[float, float, float]:
    """Mean and the middle 95 percent of the means of RESAMPLES draws; the draws are taken in blocks of bounded size, in one stream of the seed."""
    rng, means = np.random.default_rng(seed), []
    rows = max(1, min(RESAMPLES, 4_000_000 // max(len(diff), 1)))
    for at in range(0, RESAMPLES, rows):
        means.append(diff[rng.integers(0, len(diff), (min(rows, RESAMPLES - at), len(diff)))].mean(1))
    return (diff.mean(), *np.percentile(np.concatenate(means), [2.5, 97.5]))


def bootstrap_delta(pairs: DataFrame, *, by: str | None = None, order: str = "qid", sample: str = "sample", control: str = "control", seed: int = 42) -> DataFrame:
    """([by,] mean, low, high, significant, n): a paired percentile bootstrap of sample - control, per class if `by` is given.

    A class is one task: it takes as many pairs as a benchmark has queries, in the given order, so that the same seed gives the same interval.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o")
        mean, low, high = (round(float(x), 4) for x in _bootstrap((pdf["_s"] - pdf["_c"]).to_numpy(np.float64), seed))
        return pd.DataFrame({"_by": [pdf["_by"].iloc[0]], "mean": [mean], "low": [low], "high": [high], "significant": [not low <= 0 <= high], "n": [len(pdf)]})

    rows = pairs.select((F.col(by).cast("string") if by else F.lit("")).alias("_by"), F.col(order).alias("_o"), F.col(sample).alias("_s"), F.col(control).alias("_c"))
    out = rows.groupBy("_by").applyInPandas(run, "_by string, mean double, low double, high double, significant boolean, n long")
    return out.withColumnRenamed("_by", by) if by else out.drop("_by")


def class_floor_ok(per_class: DataFrame, floor: float = 0.05) -> bool:
    """No class is significantly worse by `floor` or more."""
    return not per_class.where(F.col("significant") & (F.col("mean") <= -floor)).limit(1).count()


def score_drift(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(max_drift, mean_drift): absolute differences of the first rank's score per query."""
    d = found.where("rank = 1").select("qid", F.col("score").alias("_f")).join(truth.where("rank = 1").select("qid", F.col("score").alias("_t")), "qid")
    return d.agg(F.max(F.abs(F.col("_f") - F.col("_t"))).alias("max_drift"), F.avg(F.abs(F.col("_f") - F.col("_t"))).alias("mean_drift"))


def smallest_candidate(sizes: DataFrame) -> DataFrame:
    """(item, candidate): the smallest size wins, at a tie the earliest candidate; sizes is (item, idx, candidate, size)."""
    return sizes.groupBy("item").agg(F.min_by("candidate", F.struct("size", "idx")).alias("candidate"))


def stratified_pick(df: DataFrame, bucket: str, order: str, per_bucket: int) -> DataFrame:
    """Every nth row of each bucket in order, at most per_bucket of them: n = max(1, floor(size / per_bucket)). `order` must be unique.

    A bucket of any size is spread over ranges of (bucket, order): rows are numbered over all ranges, and a bucket's first number is taken off.
    """
    numbered = dense_index(df, [bucket, order], "_place")
    sizes = df.groupBy(bucket).agg(F.count("*").alias("_size"), F.min(order).alias(order))
    firsts = numbered.select(order, F.col(bucket).alias("_b"), F.col("_place").alias("_first")).join(sizes.select(order, F.col(bucket).alias("_b2"), "_size"), order).where("_b <=> _b2").select("_b", "_first", "_size")
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / per_bucket))
    at = F.col("_place") - F.col("_first")
    picked = numbered.join(firsts, F.col(bucket).eqNullSafe(F.col("_b"))).where((at % step == 0) & (at / step < per_bucket))
    return picked.select(*df.columns)


def quality_ladder(scores: DataFrame, *, floor_p10: float, floor_min: float, drift_floor_p10: float = -1.0) -> DataFrame:
    """(level, worst_p10, least, drift_p10, passed) of scores(level, bucket, score[, drift]): a level passes if every bucket's 10th percentile, the least score and the drift's reach their floors."""
    buckets = scores.groupBy("level", "bucket").agg(F.percentile("score", 0.1).alias("p10"), F.min("score").alias("least"))
    levels = buckets.groupBy("level").agg(F.min("p10").alias("worst_p10"), F.min("least").alias("least"))
    if "drift" in scores.columns:
        levels = levels.join(scores.groupBy("level").agg(F.percentile("drift", 0.1).alias("drift_p10")), "level")
    else:
        levels = levels.withColumn("drift_p10", F.lit(None).cast("double"))
    steady = F.lit(True) if drift_floor_p10 < 0 else F.coalesce(F.col("drift_p10") >= drift_floor_p10, F.lit(False))
    return levels.withColumn("passed", (F.col("worst_p10") >= floor_p10) & (F.col("least") >= floor_min) & steady)


def chosen_level(ladder: DataFrame) -> DataFrame:
    """(chosen, passed): the largest level that passed, else the smallest of all."""
    best, least = F.max(F.when(F.col("passed"), F.col("level"))), F.min("level")
    return ladder.agg(F.coalesce(best, least).alias("chosen"), best.isNotNull().alias("passed"))
