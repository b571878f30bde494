"""Batteries of measurements: models ranked in tiers, variants against a control, and the gates that a release must pass.

Each measurement stays a column of its own; nothing is averaged over kinds of evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluate import bootstrap_delta, drift, identity_recall, label_precision, mean_reciprocal_rank, ranking_agreement, recall_at_k, score_drift, sign_test
from .search import exact_search, graph_search

# Fixed values: (variant, measure, comparison, threshold) of the release gates.
GATES = [
    ("compressed", "size_ratio", "<=", 0.40), ("tiny", "size_ratio", "<=", 0.30), ("nano", "size_ratio", "<=", 0.25), ("micro", "size_ratio", "<=", 0.25), ("mrl256-int8", "size_ratio", "<=", 0.25),
    ("compressed", "recall", ">=", 0.9999), ("tiny", "recall", ">=", 0.95), ("hybrid", "recall", ">=", 0.99), ("nano", "recall", ">=", 0.85), ("micro", "recall", ">=", 0.78), ("mrl256-int8", "recall", ">=", 0.78),
]
#: Share by which the exact variant's 95th percentile may be slower than before.
HEADROOM = 1.5


def model_tiers(models: dict[str, tuple[DataFrame, DataFrame]], gold: DataFrame | None, k: int = 10, *, reference: str | None = None) -> DataFrame:
    """(model, identity, drift_median, drift_p05, mrr, hit_at_1, hit_at_3): a row a model, a tier a group of columns, never one number of all.

    models gives for each name its vectors(ordinal, embedding) and queries(qid, query). Identity: queries whose qid is an ordinal find it among the
    first k. Drift: cosines of a model's vectors with those of `reference`, null where dimensions differ or there is none. Task: ranks of gold(qid, ordinal), null
    without one.
    """
    out = None
    for name, (vectors, queries) in models.items():
        found = exact_search(vectors, queries, k)
        row = identity_recall(found, k).select(F.lit(name).alias("model"), F.col("recall").alias("identity"))
        if reference is not None and reference != name:
            pairs = vectors.join(models[reference][0].select("ordinal", F.col("embedding").alias("_other")), "ordinal").where("size(embedding) = size(_other)")
            moved = drift(pairs, "embedding", "_other").select(F.col("median").alias("drift_median"), F.col("p05").alias("drift_p05"))
        else:
            moved = vectors.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(c) for c in ("drift_median", "drift_p05")))
        task = mean_reciprocal_rank(found, gold) if gold is not None else vectors.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(c) for c in ("mrr", "hit_at_1", "hit_at_3")))
        row = row.crossJoin(moved).crossJoin(task)  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def variant_battery(control: DataFrame, variants: dict[str, DataFrame], k: int, *, labels: DataFrame | None = None) -> DataFrame:
    """(variant, recall, overlap, tau, max_drift, delta, low, high, significant, p_value): each variant's ranking beside the control's, over the same queries.

    Rankings are (qid, rank, ordinal, score). With labels(ordinal, label) delta is the paired difference of label precision with its
    bootstrap interval, p_value the sign test's; without labels they are null.
    """
    spark, rows = control.sparkSession, []
    base = label_precision(control, labels, k).select("qid", F.col("precision").alias("control")).persist() if labels is not None else None
    for name, found in variants.items():
        recall = recall_at_k(found, control, k).agg(F.avg("recall")).first()[0]
        overlap, tau = ranking_agreement(control, found, k).agg(F.avg("overlap"), F.avg("tau")).first()
        moved = score_drift(found, control).first()["max_drift"]
        paired: tuple = (None,) * 5
        if base is not None:
            pairs = base.join(label_precision(found, labels, k).select("qid", F.col("precision").alias("sample")), "qid")
            d = bootstrap_delta(pairs).first()
            paired = (d["mean"], d["low"], d["high"], d["significant"], sign_test(pairs)["p_value"])
        rows.append((name, recall, overlap, tau, moved, *paired))
    if base is not None:
        base.unpersist()
    return spark.createDataFrame(rows, "variant string, recall double, overlap double, tau double, max_drift double, delta double, low double, high double, significant boolean, p_value double")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a folder on any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def run_sweep(rows: DataFrame, folder: str, variants: list[str], queries: DataFrame, k: int = 10, *, labels: DataFrame | None = None, **settings) -> DataFrame:
    """The battery's columns and bytes, size_ratio of each variant, built from the same rows below `folder`; the control is the preset `exact`.

    Queries are cut to a variant's dimensions as its vectors are.
    """
    from ..functions.vectors import truncate_renormalize
    from ..plans.corpus import build_corpus
    from ..plans.presets import parse_variant

    spark, built, found = rows.sparkSession, {}, {}
    for name in ["exact", *(v for v in variants if v != "exact")]:
        v = parse_variant(name)
        built[name] = build_corpus(rows, f"{folder.rstrip('/')}/{name}", preset=v.preset, mrl_dim=v.mrl_dim, **settings)
        q = queries.withColumn("query", truncate_renormalize("query", v.mrl_dim)) if v.mrl_dim else queries
        found[name] = (built[name].search_ann if built[name].ann else built[name].search)(q, k).persist()
    sizes = {name: stored_bytes(spark, c.path) for name, c in built.items()}
    weights = spark.createDataFrame([(n, b, b / sizes["exact"]) for n, b in sizes.items()], "variant string, bytes long, size_ratio double")
    out = spark.createDataFrame(variant_battery(found["exact"], found, k, labels=labels).join(weights, "variant").collect(), "variant string, recall double, overlap double, tau double, max_drift double, delta double, low double, high double, significant boolean, p_value double, bytes long, size_ratio double")  # a row a variant
    for f in found.values():
        f.unpersist()
    return out


def gate_rows(measures: DataFrame, *, p95_before: float | None = None, p95_now: float | None = None) -> DataFrame:
    """(variant, measure, value, comparison, threshold, passed) of measures(variant, size_ratio, recall): the gates of the variants that are there."""
    spark = measures.sparkSession
    gates = spark.createDataFrame(GATES, "variant string, measure string, comparison string, threshold double")
    long = measures.select("variant", F.expr("stack(2, 'size_ratio', cast(size_ratio as double), 'recall', cast(recall as double)) as (measure, value)")).where("value is not null")
    rows = long.join(F.broadcast(gates), ["variant", "measure"])  # the fixed list above
    passed = F.when(F.col("comparison") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    out = rows.select("variant", "measure", "value", "comparison", "threshold", passed.alias("passed"))
    if p95_before is not None and p95_now is not None:
        limit = HEADROOM * p95_before
        out = out.unionByName(spark.createDataFrame([("exact", "p95", p95_now, "<=", limit, p95_now <= limit)], out.schema))
    return out


def graph_recall_gate(vectors: DataFrame, edges: DataFrame, queries: DataFrame, *, k: int = 10, hops: int = 2, ef: int = 64, threshold: float = 0.90) -> DataFrame:
    """(recall, threshold, passed): the graph search's share of the exact best k."""
    r = recall_at_k(graph_search(vectors, edges, queries, k, hops=hops, ef=ef), exact_search(vectors, queries, k), k).agg(F.avg("recall").alias("recall"))
    return r.select("recall", F.lit(threshold).alias("threshold"), (F.col("recall") + 1e-9 >= threshold).alias("passed"))
