"""The chunk graph: edges(src, edge_type, dst), its construction, checks, and the bounded walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..tables import materialize

NEXT_CHUNK, SEMANTIC, CITATION = 0, 1, 2
#: Edges that one node may have.
MAX_DEGREE = 1 << 20


def next_chunk_edges(n: DataFrame) -> DataFrame:
    """Edges between consecutive ordinals, both ways; ordinals must be dense."""
    a = n.select(F.col("ordinal").alias("src"))
    both = a.select("src", F.explode(F.array(F.col("src") - 1, F.col("src") + 1)).alias("dst"))
    kept = both.join(n.select(F.col("ordinal").alias("dst")), "dst", "left_semi")
    return kept.select("src", F.lit(NEXT_CHUNK).cast("tinyint").alias("edge_type"), "dst")


def semantic_edges(neighbors: DataFrame, top_m: int) -> DataFrame:
    """The best top_m neighbours of each node, from ranked (qid, rank, ordinal) rows; a node is not its own neighbour."""
    others = neighbors.where("qid != ordinal")
    w = Window.partitionBy("qid").orderBy("rank")
    best = others.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_m)
    return best.select(F.col("qid").alias("src"), F.lit(SEMANTIC).cast("tinyint").alias("edge_type"), F.col("ordinal").alias("dst"))


def build_graph(chunks: DataFrame, neighbors: DataFrame | None, *, top_m: int = 8) -> DataFrame:
    """Consecutive and semantic edges in canonical order (src, edge_type, dst) inside each partition of src ranges."""
    edges = next_chunk_edges(chunks)
    if neighbors is not None:
        edges = edges.unionByName(semantic_edges(neighbors, top_m))
    return edges.repartitionByRange("src").sortWithinPartitions("src", "edge_type", "dst")


def check_graph(edges: DataFrame, n_chunks: int) -> None:
    """Refuse edges to or from unknown nodes and nodes of too many edges."""
    bad = edges.where((F.col("src") < 0) | (F.col("dst") < 0) | (F.col("src") >= n_chunks) | (F.col("dst") >= n_chunks)).limit(1).count()
    if bad:
        raise ValidationError(f"an edge leaves the range 0..{n_chunks - 1}")
    if edges.groupBy("src").count().where(F.col("count") > MAX_DEGREE).limit(1).count():
        raise ValidationError(f"a node has more than {MAX_DEGREE} edges")


def bounded_bfs(edges: DataFrame, seeds: DataFrame, *, hops: int, max_frontier: int, n_chunks: int | None = None) -> DataFrame:
    """(qid, node, arrival, hop): seeds first in their order, then level by level in order of arrival, at most max_frontier nodes a query.

    seeds is (qid, node, arrival). A node arrives through its earliest parent, then by (edge_type, dst); it counts once.
    Seeds out of 0..n_chunks-1 are ignored. Arrival counts from 0. Each level is one join with the edges and one window per
    query, whose rows are bounded by max_frontier times the largest degree; the levels are unrolled, hops is small.
    """
    order = Window.partitionBy("qid").orderBy("arrival", "node")
    s = seeds.groupBy("qid", "node").agg(F.min("arrival").alias("arrival"))
    if n_chunks is not None:
        s = s.where((F.col("node") >= 0) & (F.col("node") < n_chunks))
    seen = s.withColumn("arrival", F.row_number().over(order) - 1).where(F.col("arrival") < max_frontier).withColumn("hop", F.lit(0))
    e = edges.select(F.col("src").alias("_src"), F.col("edge_type").alias("_type"), F.col("dst").alias("_dst"))
    for hop in range(1, hops + 1):
        frontier = seen.where(F.col("hop") == hop - 1).select(F.col("qid").alias("_q"), F.col("node").alias("_src"), F.col("arrival").alias("_parent"))
        reached = frontier.join(e, "_src").groupBy(F.col("_q").alias("qid"), F.col("_dst").alias("node")).agg(F.min(F.struct("_parent", "_type", "_dst")).alias("_how"))
        fresh = reached.join(seen.select("qid", "node"), ["qid", "node"], "left_anti")
        so_far = seen.groupBy("qid").agg(F.count("*").alias("_n"))
        w = Window.partitionBy("qid").orderBy("_how")
        fresh = fresh.join(so_far, "qid").withColumn("arrival", (F.col("_n") + F.row_number().over(w) - 1).cast("int"))
        fresh = fresh.where(F.col("arrival") < max_frontier).select("qid", "node", "arrival", F.lit(hop).alias("hop"))
        seen = seen.unionByName(fresh)
        if hop < hops:  # the next level reads it three times
            seen = materialize(seen, "walk")
    return seen
